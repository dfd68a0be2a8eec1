import math
import unicodedata

import pytest
from pyspark.sql import functions as F

from mnemora.functions import scoring as S
from mnemora.functions import telex
from mnemora.functions import text as T


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


@pytest.mark.parametrize(
    ("kind", "source", "want"),
    [("preference", None, 0.9), ("decision", "reflect", 0.95), ("preference", "reflect", 1.0), ("session", "hook", 0.1), ("entity", "my-own-hook", 0.3), ("unknown", None, 0.5), ("tool", "wrap", 0.4)],
)
def test_initial_importance(spark, kind, source, want):
    got = one(spark, S.initial_importance(F.lit(kind), F.lit(source).cast("string")))
    assert got == pytest.approx(want)


def test_decay_and_boosts(spark):
    assert one(spark, S.decay(F.lit(0.8), F.lit(10))) == pytest.approx(0.8 * math.exp(-0.16 * (1 - 0.64) * 10))
    assert one(spark, S.decay(F.lit(0.8), F.lit(0))) == 0.8
    assert one(spark, S.decay(F.lit(0.0), F.lit(5))) == 0.0
    assert one(spark, S.access_boost(F.lit(0.5), F.lit(10))) == pytest.approx(0.5 + 0.03 * math.log(11))
    assert one(spark, S.access_boost(F.lit(0.99), F.lit(1000))) == 1.0
    assert one(spark, S.hub_boost(F.lit(25))) == pytest.approx(0.2)
    assert [S.oversample(k) for k in (1, 3, 4, 5, 6, 7, 20, 100)] == [8, 8, 8, 10, 12, 12, 12, 12]


TELEX = {
    "giaiar": "giải", "dduowcj": "được", "keiuer": "kiểu", "khongr": "không", "nhieuf": "nhiều", "lamf": "làm", "roif": "rồi", "viecj": "việc", "khocs": "khóc", "buoonf": "buồn", "gianr": "giận",
    "ddij": "đị", "uwf": "ừ", "thuaanj": "thuận", "dduocj": "được", "(giaiar)": "(giải)", '"dduowcj"': '"được"', "dduowcj.": "được.", "giaiar!": "giải!", "khongr?": "không?", "Giaiar": "Giải",
    "Dduowcj": "Được", "Khongr": "Không", "(khongr),": "(không),", "uwowcs": "ước", "ngheej": "nghệ", "quyeenx": "quyễn", "giuwx": "giữ", "ddoas": "đóa", "ddoanf": "đoàn", "ddeeu": "đêu", "dduar": "đủa",
}
SAME = [
    "fox", "box", "tower", "floor", "school", "knows", "shows", "moons", "six", "raj", "awesome", "street", "flow", "grow", "python", "docker", "react", "hello", "world", "the", "is", "book",
    "API", "URL", "JSON", "được", "không", "đã", "123", "test123", "https://example.com", "http://a.b/ddi", "ddos", "DDoS", "uwsgi", "uWSGI", "Kuwait", "thruway", "v2", "DDUOWCJ", "...", "quowf", "a",
]


@pytest.mark.parametrize(("typed", "want"), [*TELEX.items(), *((w, w) for w in SAME)])
def test_telex(typed, want):
    assert telex.repair_word(typed) == want


def test_telex_table():
    """Every entry is one onset, nucleus and coda with its tone, typed as the keyboard has it."""
    table = telex.forms()
    assert len(table) > 15_000
    for typed, meant in table.items():
        bare = "".join(c for c in unicodedata.normalize("NFD", meant) if c not in set(telex.TONES.values()))
        assert typed.isascii() and typed.isalpha() and unicodedata.is_normalized("NFC", meant) and len(unicodedata.normalize("NFC", bare)) == len(meant)


def test_telex_texts(spark):
    assert telex.repair("  a   dduowcj\nb ") == "a được b"
    assert telex.repair("") == "" and telex.repair(None) is None
    df = spark.createDataFrame([("thuaanj  ok",), (None,)], "t string").select(telex.normalize(F.col("t")).alias("x"))
    assert [r["x"] for r in df.collect()] == ["thuận ok", None]


def test_folding(spark):
    assert one(spark, T.fold_all(F.lit("Mệt mỏi, ĐÁM cưới, Không"))) == "met moi, dam cuoi, khong"
    assert one(spark, T.fold(F.lit("đÉ"))) == "đe"


GATE = [
    ("hi", None, True, "too_short"),
    ("x" * 5001, None, False, "long_prompt"),
    ("/deploy the thing", None, True, "confident:slash"),
    ("!git status now", None, True, "confident:bash"),
    ("fix that one thing", None, True, "trivial_short"),
    ("fix bug in scripts/derive.sh", None, False, "default_include|llm_fail"),
    ("is it done yet?", "skip", False, "llm_skip_ignored"),
    ("one two three four five six seven eight nine", None, False, "substantive_length"),
    ("continue please but check this", None, False, "contrast:but"),
    ("ok let me try that approach", None, True, "pattern:continuation_en|llm_fail"),
    ("ok let me try that approach", "skip", True, "agree_skip:continuation_en"),
    ("ok let me try that approach", "include", False, "llm_rescue:continuation_en"),
    ("thanks that worked perfectly now", "skip", True, "agree_skip:ack_thanks"),
    ("go ahead and proceed with it", "skip", True, "agree_skip:imperative"),
    ("rename the judge module today please", "include", False, "agree_include"),
]


def test_skip_gate(spark):
    df = spark.createDataFrame([(p, v) for p, v, _, _ in GATE], "p string, v string").select(T.skip_gate(F.col("p"), F.col("v")).alias("g"))
    assert [(r["g"]["skip"], r["g"]["reason"]) for r in df.collect()] == [(s, w) for _, _, s, w in GATE]


def test_guards(spark):
    pairs = [("Phase 3 EXECUTED", "Tier 2 LANDED", True), ("2024-01-02 weight 70 kg", "2024-02-02 weight 71 kg", True), ("we use Kafka", "we use Pulsar instead", False)]
    df = spark.createDataFrame(pairs, "a string, b string, w boolean")
    assert all(r["x"] == r["w"] for r in df.select(T.series_pair(F.col("a"), F.col("b")).alias("x"), "w").collect())
    assert one(spark, T.reversal(F.lit("dùng cái này THAY VÌ cái kia")))


def test_clips_and_parsers(spark):
    assert one(spark, T.clip(F.lit("aaa bbb ccc ddd"), 9)) == "aaa bbb…"
    assert one(spark, T.clip(F.lit("short"), 9)) == "short"
    assert one(spark, T.clip(F.lit("a bbbbbbbbbbbbbbb"), 10)) == "a bbbbbbbb…"
    assert one(spark, T.truncate(F.lit("one two three, four"), 14)) == "one two three…"
    got = one(spark, T.facts(F.lit("x\nFACT: decision | 8 | use B | not C\nFACT: bad | x | y\nFACT: a|b")))
    assert [(g["category"], g["confidence"], g["content"]) for g in got] == [("decision", 0.8, "use B | not C")]
    assert one(spark, T.safety(F.lit("sudo rm -rf /tmp/x"))) == "recursive force delete"
    assert one(spark, T.safety(F.lit("git restore --staged ."))) is None
    assert one(spark, T.fingerprint(F.lit("head\nbody"))) == one(spark, T.fingerprint(F.lit("other head\nbody ")))
    assert one(spark, T.quoted(F.lit('judge.py -- "x"'))) == '"judge.py" """x"""'
    assert one(spark, T.set_hash(F.lit("q"), F.array(F.lit("b"), F.lit("a")))) == one(spark, T.set_hash(F.lit("q"), F.array(F.lit("a"), F.lit("b"))))
    assert one(spark, T.project_of(F.lit("/home/x/Projects/atlas/src"))) == "atlas"


def test_saveable_looks_for_words_before_patterns(spark):
    """Equal to the patterns alone, which are tried after plain words."""
    import re

    pad = " and so the whole matter went on for as long as it took"
    lines = ["WE DECIDED it", "a Trade-Off", "tradeoff x", "deferred it, because", "won't go because", "fundamental old issue", "at v1.2.3 now", "gpt-4o", "GPT-x", "90% faster", "O(n^2) x", "O(log) x", "SELECT a FROM b", "min_cluster=3", "sim_threshold=.5", "nothing", "undecided", "12"]
    df = spark.createDataFrame([(x + pad,) for x in lines], "x string")
    found = df.select("x", T.saveable_excerpt(F.col("x"), 10, 10).alias("got"))
    want = lambda x: re.search("(?i)" + "|".join(T.DECISION_PHRASES), x) or re.search("|".join(T.TECHNICAL_PATTERNS), x)
    assert all((r["got"] is not None) == bool(want(r["x"])) for r in found.collect())
    assert "contains(" in found._jdf.queryExecution().optimizedPlan().toString().lower()


def test_telex_repairs_a_batch_in_slices(monkeypatch):
    import pyarrow as pa

    from mnemora.functions import telex

    monkeypatch.setattr(telex, "SLICE", 2)
    texts = ["dduowng", None, "", "x" * 300, "ban ddaf"]
    assert telex.repaired(pa.array(texts)).to_pylist() == [telex.repair(t) for t in texts]
    assert telex.repaired(pa.array([], pa.string())).to_pylist() == []
