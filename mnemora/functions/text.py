"""Text functions as Columns: folding, tokens, clipping, keywords, gates and classifiers."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F


def _folds() -> tuple[str, str]:
    """Every Latin letter that decomposes into a base letter and marks, and its base, by the Unicode rule."""
    src, dst = [], []
    for code in [*range(0xC0, 0x250), *range(0x1E00, 0x1F00)]:
        base = unicodedata.normalize("NFD", chr(code))
        if len(base) > 1 and all(unicodedata.category(c)[0] == "M" for c in base[1:]):
            src.append(chr(code))
            dst.append(base[0])
    return "".join(src), "".join(dst)


FOLD_FROM, FOLD_TO = _folds()

# English function words left out of keywords.
STOPWORDS = (
    "a an the is are was were be been being have has had do does did will would shall should may might can could "
    "of in to for with on at by from as into that this it its and or but not no nor so yet both either neither each "
    "every all any few more most other some such than too very"
).split()


def fold(text: Column) -> Column:
    """Lower case without accents; letters without a decomposition, such as đ, stay."""
    return F.lower(F.translate(text, FOLD_FROM, FOLD_TO))


def fold_all(text: Column) -> Column:
    """Lower case without accents, đ being d: for fuzzy comparison, not for the index."""
    return fold(F.translate(text, "đĐ", "dD"))


def tokens(text: Column) -> Column:
    """Index terms: folded runs of letters and digits, in order."""
    return F.filter(F.split(fold(text), r"[^\p{L}\p{N}]+"), lambda t: t != "")


def query_phrases(query: Column) -> Column:
    """A safe all-of query: white-space tokens with a letter or digit, the first 16; each is a phrase of index terms."""
    kept = F.filter(F.split(query, r"\s+"), lambda t: t.rlike(r"[\p{L}\p{N}]"))
    return F.slice(kept, 1, 16)


def quoted(query: Column) -> Column:
    """``query_phrases`` as one string, each token in double quotes with inner quotes doubled."""
    return F.array_join(F.transform(query_phrases(query), lambda t: F.concat(F.lit('"'), F.replace(t, F.lit('"'), F.lit('""')), F.lit('"'))), " ")


def any_words(query: Column, limit: int = 8) -> Column:
    """Words of an any-of query: stripped of punctuation, alphanumeric, longer than two, the first ``limit``."""
    bare = F.transform(F.split(F.substring(query, 1, 1000), r"\s+"), lambda t: F.regexp_replace(t, r"^[,.!?;:'\"()\[\]{}]+|[,.!?;:'\"()\[\]{}]+$", ""))
    return F.slice(F.filter(bare, lambda t: (F.length(t) > 2) & t.rlike(r"^[\p{L}\p{N}]+$")), 1, limit)


def tool_words(query: Column, limit: int = 8) -> Column:
    """Words of a tool query: punctuation to spaces, three letters or more, the first ``limit``."""
    parts = F.split(F.regexp_replace(query, r"[^\p{L}\p{N}_\s]", " "), r"\s+")
    return F.slice(F.filter(parts, lambda t: F.length(t) >= 3), 1, limit)


def context_words(text: Column, keep: int | None = None) -> Column:
    """Distinct lower-case alphanumeric words of three letters or more; the last ``keep`` of them."""
    words = F.array_distinct(F.filter(F.split(F.lower(text), r"\s+"), lambda t: (F.length(t) >= 3) & t.rlike(r"^[\p{L}\p{N}]+$")))
    return words if keep is None else F.slice(words, F.greatest(F.size(words) - keep + 1, F.lit(1)), keep)


def keywords(text: Column) -> Column:
    """Distinct ASCII words of three letters or more without function words."""
    return F.array_except(F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit(r"([a-z]{3,})"), 1)), F.array(*[F.lit(w) for w in STOPWORDS]))


def combined_query(prompt: Column, context: Column) -> Column:
    """The prompt's first 1000 characters and the words gathered from earlier prompts."""
    head = F.substring(prompt, 1, 1000)
    return F.when(F.size(F.coalesce(context, F.array().cast("array<string>"))) > 0, F.concat_ws(" ", head, F.array_join(context, " "))).otherwise(head)


def clip(text: Column, limit: int, least: float = 0.5) -> Column:
    """At most ``limit`` characters, cut at the last space unless that is before ``least`` of the limit; an ellipsis marks the cut."""
    head = F.substring(text, 1, limit)
    at = F.length(head) - F.instr(F.reverse(head), " ")  # characters before the last space
    cut = F.when((F.instr(head, " ") > 0) & (at >= int(limit * least)), at).otherwise(limit)
    return F.when(F.length(text) <= limit, text).otherwise(F.concat(F.substring(head, F.lit(1), cut), F.lit("…")))


def flat_clip(text: Column, limit: int = 200) -> Column:
    """One line of words, clipped."""
    return clip(F.trim(F.regexp_replace(text, r"\s+", " ")), limit)


def truncate(text: Column, limit: int) -> Column:
    """Trimmed and clipped at a word past 60 % of the limit, without trailing punctuation before the ellipsis."""
    t = F.trim(text)
    head = F.substring(t, 1, limit)
    at = F.length(head) - F.instr(F.reverse(head), " ")
    cut = F.when((F.instr(head, " ") > 0) & (at > limit * 0.6), F.substring(head, F.lit(1), at)).otherwise(head)
    return F.when(F.length(t) <= limit, t).otherwise(F.concat(F.regexp_replace(cut, "[ ,;:.\\-—]+$", ""), F.lit("…")))


def strip_code(text: Column) -> Column:
    """Without fenced blocks and then inline code."""
    return F.regexp_replace(F.regexp_replace(text, r"```[\s\S]*?```", ""), r"`[^`]+`", "")


def fingerprint(text: Column) -> Column:
    """Sixteen hex digits of the body's SHA-256, the first line left out."""
    body = F.when(F.instr(text, "\n") > 0, F.substring(text, F.instr(text, "\n") + 1, F.length(text))).otherwise(text)
    return F.substring(F.sha2(F.trim(body), 256), 1, 16)


def set_hash(query: Column, ids: Column) -> Column:
    """A hash of a query and a set of ids, whatever the ids' order."""
    return F.md5(F.concat(query, F.lit("\0"), F.array_join(F.array_sort(ids), ",")))


# Words and phrases that mark a personal prompt.
EMOTIONAL_WORDS = ["khóc", "buồn", "giận", "tức", "stress", "anxious", "crying", "funeral", "grieving", "depressed"]
EMOTIONAL_PHRASES = ["mệt mỏi", "tâm lý", "cảm xúc", "lo lắng", "đau lòng", "ổn định lại", "đám tang", "đám cưới"]
EMOTIONAL_EXPANSION = "emotional family relationships personal reflect"


def emotional(text: Column, phrases: list[str] = EMOTIONAL_PHRASES, words: list[str] = EMOTIONAL_WORDS) -> Column:
    """Whether a phrase occurs, accents aside, or one of the words stands alone."""
    bare = unicodedata.normalize
    folded = fold_all(text)
    out = F.lit(False)
    for p in phrases:
        plain = "".join(c for c in bare("NFD", p.replace("đ", "d")) if unicodedata.category(c)[0] != "M").lower()
        out = out | folded.contains(plain)
    stripped = F.transform(F.split(F.lower(text), r"\s+"), lambda w: F.regexp_replace(w, r"^[,.!?;:'\"()\[\]{}]+|[,.!?;:'\"()\[\]{}]+$", ""))
    return out | F.arrays_overlap(stripped, F.array(*[F.lit(w) for w in words]))


# Patterns of series entries, measurements, dates and reversals in memories.
SERIES = r"(?iu)EXECUTED|GREEN|ADR-?\d+|Tier ?\d|\bP-?\d|P\dc|LANDED|milestone|\bGUT\b|✅"
MEASURE = r"(?iu)\d+(?:[.,]\d+)?\s*(?:g\b|kg|cm|gib|mib|gb|mb|chỉ|chi\b|%|tools?|tests?|commits?|triệu|M\b)"
DATED = r"\d{4}-\d{2}-\d{2}|\d{1,2}/\d{4}|\d{1,2}/\d{1,2}/\d{2,4}"
REVERSAL = r"(?iu)\binstead\b|no longer|\bsai\b|reversed|RETIRED|now corrected|\bwrong\b|deprecated|superseded|thay vì|đảo chiều|không còn|hủy bỏ"


def series_marks(text: Column) -> Column:
    """What ``series_pair`` asks of a content, as two booleans: formulaic, and a dated measurement."""
    return F.struct(text.rlike(SERIES).alias("formula"), (text.rlike(DATED) & text.rlike(MEASURE)).alias("dated"))


def series_marked(a: Column, b: Column) -> Column:
    """``series_pair`` of contents by their marks."""
    return (a["formula"] & b["formula"]) | (a["dated"] & b["dated"])


def series_pair(a: Column, b: Column) -> Column:
    """Whether two contents are entries of one series: both formulaic, or both dated measurements."""
    return series_marked(series_marks(a), series_marks(b))


def reversal(text: Column) -> Column:
    return text.rlike(REVERSAL)


# Phrases and patterns of answers worth saving.
DECISION_PHRASES = [r"\bwe decided\b", r"\broot cause\b", r"\bthe fix is\b", r"\barchitectural\b", r"\btrade-?off\b", r"\bapproach chosen\b", r"\bdeferred\b.*\bbecause\b", r"\bwon't\b.*\bbecause\b", r"\bkey insight\b", r"\bfundamental\b.*\bissue\b"]
TECHNICAL_PATTERNS = [r"\bv\d+\.\d+\.\d+\b", r"\bgpt-[\w.-]+\b", r"\b\d+%\b.*\b(accuracy|reduction|improvement|faster)\b", r"\b(O\(n\^?\d*\)|O\(log\))\b", r"\bSELECT\b.*\bFROM\b", r"\bmin_cluster=\d+\b", r"\bsim_threshold=[\d.]+\b"]


#: In lower case, every match of a decision phrase holds one of these; every match of a technical pattern a digit or one of those.
DECISION_WORDS = ["we decided", "root cause", "the fix is", "architectural", "trade", "approach chosen", "deferred", "won't", "key insight", "fundamental"]
TECHNICAL_SIGNS = r"[0-9]|gpt-|O\((?:n|log)|SELECT"


def saveable_excerpt(text: Column, least_line: int = 60, least_text: int = 200, limit: int = 120) -> Column:
    """The first line long enough that holds a decision phrase or a technical pattern; null in short texts.

    Patterns are tried on lines only that hold what a match of theirs must hold.
    """
    lines = F.transform(F.split(text, "\n"), lambda x: F.struct(F.trim(x).alias("x"), F.lower(x).alias("low")))

    def holds(line: Column) -> Column:
        said = F.lit(False)
        for w in DECISION_WORDS:
            said = said | F.contains(line["low"], F.lit(w))
        return (said & line["x"].rlike("(?i)" + "|".join(DECISION_PHRASES))) | (line["x"].rlike(TECHNICAL_SIGNS) & line["x"].rlike("|".join(TECHNICAL_PATTERNS)))

    found = F.filter(lines, lambda line: (F.length(line["x"]) >= least_line) & holds(line))
    return F.when(F.length(text) >= least_text, F.substring(F.get(found, F.lit(0))["x"], 1, limit))


# Categories of tools by words of their description, the first that fits.
CATEGORIES = [
    ("game-dev", ["godot", "gdd", "gut test", "gdscript", "gdformat", "gdlint"]),
    ("infra", ["podman", "setup.sh", "prerequisite", "diagnostics", "media stack"]),
    ("finance", ["financial", "budget", "projection", "runway"]),
    ("freelance", ["upwork", "proposal", "gig"]),
    ("triage", ["inbox", "triage"]),
    ("coaching", ["accountability", "milestone", "mentor"]),
    ("self", ["reflect", "profile dimension", "staleness", "satisfaction"]),
    ("learning", ["anki", "flashcard", "vocab", "learning path"]),
    ("scheduling", ["schedule", "quest", "calendar", "optimize day"]),
    ("optimization", ["token", "consumption", "context waste"]),
    ("content", ["video", "storyboard", "tts", "book video", "youtube", "facebook", "metadata for", "narrative arc", "pacing", "per-scene", "image prompts"]),
    ("creative", ["generate image", "concept art"]),
    ("library", ["calibre", "owned book", "owned-library", "my shelf", "book library", "titles to acquire"]),
    ("research", ["research", "decision intelligence"]),
    ("development", ["github issue", "commit", "open pr", "ship change", "fix.*issue", "ship", "lint.*test.*review", "sub-project", "scaffold"]),
    ("knowledge", ["obsidian", "vault note", "catalog insight", "sync.*compact"]),
    ("infra", ["setup", "dry-run", "prerequisite"]),
]


def category(description: Column) -> Column:
    """A tool's category, ``general`` where no word fits."""
    out, text = F.lit("general"), F.lower(description)
    for name, words in reversed(CATEGORIES):
        out = F.when(text.rlike("|".join(words)), name).otherwise(out)
    return out


# Commands that need a confirmation, in the order that they are tested.
SAFETY = [
    (r"rm\s+-[a-zA-Z]*r[a-zA-Z]*f", "recursive force delete"),
    (r"git\s+clean\s+-[a-zA-Z]*f", "git clean -f"),
    (r"git\s+branch\s+[^|;&]*(-[a-zA-Z]*D\b|--delete\s+--force|--force\s+--delete)", "git branch -D"),
    (r"git\s+checkout\s+(--\s+)?\.(\s|$)", "git checkout ."),
    (r"git\s+restore\s+([^|;&]*\s)?\.(\s|$)", "git restore ."),
    (r"git\s+(add|commit)", "staged files"),
]


def safety(command: Column) -> Column:
    """Why a command needs a confirmation, or null.  Unstaging everything does not; commits do for the files to be looked at."""
    out = F.lit(None).cast("string")
    for pattern, why in reversed(SAFETY):
        fits = command.rlike(pattern)
        if why == "git restore .":
            fits = fits & ~command.rlike(r"restore\s+--staged\s+\.(\s|$)")
        out = F.when(fits, why).otherwise(out)
    return out


# The skip gate's markers and patterns.
CONTRAST = ["but", "however", "though", "except", "actually", "wait", "nhưng", "tuy nhiên", "ngoại trừ", "thực ra", "khoan"]
CONFIDENT = [("slash", r"(?iu)^/[a-z][a-z0-9_-]*(\s|$)"), ("bash", r"^!")]
TENTATIVE = [
    ("continuation_en", r"(?iu)^(ok|yes|sure|alright|right|got it|cool|nice|good|great)[,.]?\s+(let|let'?s|just|then|now|go|please|do|make|try|run|continue|proceed)\b"),
    ("continuation_vn", r"(?iu)^(ok|được|đúng|tiếp|làm|thử)\s+(rồi|đi|tiếp|nha|nhé|tục|theo|vậy|làm|thử|cứ|cách)\b"),
    ("imperative", r"(?iu)^(go ahead|just do|please do|now do|do that|làm đi|chạy đi)\b"),
    ("ack_thanks", r"(?iu)^(thanks?|thank you|cảm ơn|cám ơn|tks)[,.\s]"),
]


def skip_gate(prompt: Column, vote: Column) -> Column:
    """Whether memory is skipped for a prompt, and why: a struct (skip, reason).

    ``vote`` is a model's opinion, ``skip``, ``include`` or null where it
    failed.  The vote can rescue a prompt that patterns would skip and cannot
    veto one that they include.
    """
    p = F.trim(prompt)
    words = F.filter(F.split(p, r"\s+"), lambda w: w != "")
    bare = lambda w: F.regexp_replace(w, "^[.,!]+|[.,!]+$", "")
    code = F.exists(words, lambda w: w.contains("/") | w.contains("_") | w.contains("::") | w.contains("()") | (bare(w).contains(".") & ~F.replace(bare(w), F.lit(".")).rlike(r"^\d+$")))
    out = lambda skip, reason: F.struct(F.lit(skip).alias("skip"), (reason if isinstance(reason, Column) else F.lit(reason)).alias("reason"))
    low = F.lower(p)
    first = F.lit(None).cast("string")
    for name, pattern in reversed(TENTATIVE):
        first = F.when(p.rlike(pattern), name).otherwise(first)
    gate = F.when(F.length(p) < 10, out(True, "too_short")).when(F.length(p) > 5000, out(False, "long_prompt"))
    for name, pattern in CONFIDENT:
        gate = gate.when(p.rlike(pattern), out(True, f"confident:{name}"))
    gate = gate.when((F.size(words) <= 4) & ~p.contains("?") & ~code, out(True, "trivial_short")).when(F.size(words) > 8, out(False, "substantive_length"))
    for m in CONTRAST:
        gate = gate.when(F.concat(F.lit(" "), low, F.lit(" ")).contains(f" {m} ") | low.startswith(f"{m} "), out(False, f"contrast:{m}"))
    gate = gate.when(vote.isNull() & first.isNotNull(), out(True, F.concat(F.lit("pattern:"), first, F.lit("|llm_fail"))))
    gate = gate.when(vote.isNull(), out(False, "default_include|llm_fail"))
    gate = gate.when(first.isNotNull() & (vote == "skip"), out(True, F.concat(F.lit("agree_skip:"), first)))
    gate = gate.when(first.isNull() & (vote == "include"), out(False, "agree_include"))
    gate = gate.when(first.isNotNull(), out(False, F.concat(F.lit("llm_rescue:"), first)))
    return gate.otherwise(out(False, "llm_skip_ignored"))


def facts(text: Column) -> Column:
    """``FACT: category | confidence | text`` lines as structs, the confidence in tenths."""
    lines = F.transform(F.split(text, "\n"), lambda x: F.trim(x))
    parts = F.transform(F.filter(lines, lambda x: x.startswith("FACT:")), lambda x: F.split(F.substring(x, F.lit(6), F.length(x)), r"\|", 3))
    made = F.transform(F.filter(parts, lambda p: F.size(p) == 3), lambda p: F.struct(F.trim(p[0]).alias("category"), (F.trim(p[1]).try_cast("double") / 10).alias("confidence"), F.trim(p[2]).alias("content")))
    return F.filter(made, lambda s: (s["content"] != "") & s["confidence"].isNotNull())


def user_text(text: Column, prefixes: list[str]) -> Column:
    """A user's own words: cut at an injected reminder, null where a wrapper's prefix begins the text."""
    own = F.trim(F.substring_index(text, "<system-reminder>", 1))
    out = F.lit(False)
    for p in prefixes:
        out = out | own.startswith(p)
    return F.when(~out & (own != ""), own)


def project_of(path: Column, root: str = "Projects") -> Column:
    """The first folder below the projects root; null where there is none."""
    return F.nullif(F.regexp_extract(path, rf"/{root}/([^/]+)", 1), F.lit(""))


def project_kind(has_game_file: Column, has_infra_file: Column) -> Column:
    """A project's kind by its marker files."""
    return F.when(has_game_file, "godot").when(has_infra_file, "infra").otherwise("app")


def file_paths(tool_input: Column) -> Column:
    """Distinct paths in a serialised tool input, in order."""
    return F.array_distinct(F.regexp_extract_all(tool_input, F.lit(r'"(?:file_path|path)":\s*"([^"]+)"'), 1))
