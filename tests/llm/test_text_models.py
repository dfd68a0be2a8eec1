import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from mnemora.llm import decontam, langid, toxicity, urlfilter


def crc(i):
    return zlib.crc32(str(i).encode())


# --- url filters ------------------------------------------------------------

RULES = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow")]


def host_path(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    k = next((i for i, c in enumerate(rest) if c in "/?#"), len(rest))
    host, tail = rest[:k], rest[k:]
    k = next((i for i, c in enumerate(tail) if c in "?#"), len(tail))
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host), tail[:k]


def rule(host, path):
    fits = [(h + p, a) for h, p, a in RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return max(fits, key=lambda f: len(f[0]), default=(None, None))


URLS = [
    "http://a.example.net/en/1", "http://A.Example.NET/fr/1?x=/en/", "https://b.example.com/de/x#/q", "https://example.com/de", "http://x.org/fr/", "http://x.org/en/",
    "http://net/", "http://net", "http://internet/a", "ftp://é.Ünet/a", "no scheme", None, "", "://h/p", "a://b://c/d", "http://h?q=/p", "http://h#f", "HTTP://UPPER.ORG/FR/", "http://u.org/fr/\nx",
]


def test_hosts_paths_and_rules(spark):
    rows = [(i, u, "clash") for i, u in enumerate(URLS)] + [(None, "http://x.net/", "c"), (3, URLS[3], "c")]
    got = urlfilter.judge(spark.createDataFrame(rows, "page_id long, url string, host string"), RULES).collect()
    assert len(got) == len(rows)
    by = {i: u for i, u, _ in rows}
    for r in got:
        h, p = host_path(by[r["page_id"]])
        name, action = rule(h, p)
        assert (r["host"], r["path"], r["rule"]) == (h, p, name)
        assert r["verdict"] == (action or "allow")
    assert urlfilter.judge(spark.createDataFrame([], "page_id long, url string"), RULES).count() == 0


def tree(rows):
    """The template tree by plain loops: rows of (host, path, n, labelled, bad)."""
    state = [[h, (p.split("/")[1:] if p else []), "", n, l, b] for h, p, n, l, b in rows]
    for k in range(max(len(s[1]) for s in state)):
        nodes = {}
        for h, parts, t, n, l, b in state:
            if k < len(parts):
                c = nodes.setdefault((h, t), {}).setdefault(parts[k], [0] * 7)
                after = parts[k + 1] if k + 1 < len(parts) else None
                kind = 0 if after is None else 1 if after == "" else 2 if after[0].isdigit() else 3
                for i, v in ((0, n), (1, l), (2, b), (3 + kind, n)):
                    c[i] += v
        names = {}
        for node, kids in nodes.items():
            n, once, z = sum(c[0] for c in kids.values()), sum(c[0] == 1 for c in kids.values()), 1.96
            low = lambda q: (q + z * z / (2 * n) - z * ((q * (1 - q) + z * z / (4 * n)) / n) ** 0.5) / (1 + z * z / n)  # noqa: B023, E731
            starred = {s for s, c in kids.items() if low(c[0] / n) < 0.05} if low(once / n) >= 0.2 else set()
            names.update({(node, s): "*" for s in starred})
            rest = {s: c for s, c in kids.items() if c[1] and s not in starred}
            for _ in range(2):
                if not rest:
                    break
                lead = max(rest, key=lambda s: (rest[s][0], rest[s][1], s))
                L, alike = rest[lead], []
                for s, c in rest.items():
                    pool = (c[2] + L[2]) / (c[1] + L[1])
                    same = abs(c[2] / c[1] - L[2] / L[1]) <= 1.96 * (pool * (1 - pool) * (1 / c[1] + 1 / L[1])) ** 0.5
                    chi = sum((c[i] / c[0] - L[i] / L[0]) ** 2 / (c[i] + L[i]) for i in range(3, 7) if c[i] + L[i]) * c[0] * L[0]
                    if s != lead and same and chi <= 7.815:
                        alike.append(s)
                if alike:
                    names.update({(node, s): f"~{lead}" for s in [*alike, lead]})
                rest = {s: c for s, c in rest.items() if s != lead and s not in alike}
        for s in state:
            if k < len(s[1]):
                s[2] += "/" + names.get(((s[0], s[2]), s[1][k]), s[1][k])
    total_l, total_b = sum(s[4] for s in state), sum(s[5] for s in state)
    base, hosts, temps = (total_b + 1) / (total_l + 2), {}, {}
    for h, _, t, _, l, b in state:
        for d, key in ((hosts, h), (temps, (h, t))):
            e = d.setdefault(key, [0, 0])
            e[0] += l
            e[1] += b
    share = {h: (b + 4 * base) / (l + 4) for h, (l, b) in hosts.items()}
    return {k: (b + 4 * share[k[0]]) / (l + 4) for k, (l, b) in temps.items()}


def test_templates_by_plain_loops(spark):
    from mnemora.llm.common import Scratch

    rng = np.random.default_rng(0)
    rows = []
    for h in ("a", "b"):
        rows += [(h, f"/shop/item-{i}/buy", 1, i % 2, i % 2) for i in range(40)]  # an open set: one wildcard, all bad
        rows += [(h, f"/news/{c}/{c}{i}", 1, int(rng.integers(0, 2)), 0) for c in "xyz" for i in range(25)]  # alike: merged
        rows += [(h, "/spam/1", 30, 25, 25), (h, "", 5, 0, 0), (h, "/", 5, 1, 0), (h, "/a/b/c/d/e/f/g/h", 2, 0, 0)]
        rows += [(h, f"/{s}/9", 20, 10, 10) for s in ("p", "q")] + [(h, f"/{s}/", 20, 10, 10) for s in ("u", "v")]
    df = spark.createDataFrame(rows, "host string, path string, n long, labelled long, bad long")
    got = urlfilter.templates(df, Scratch(spark, "t")).collect()
    want = tree(rows)
    assert len(got) == len(rows)
    for r in got:
        assert r["purity"] == pytest.approx(want[r["host"], r["template"]])
    names = {(r["host"], r["path"]): r["template"] for r in got}
    assert names["a", "/shop/item-3/buy"] == "/shop/*/buy" and names["a", "/news/x/x3"] == "/news/~z/*" and names["a", "/a/b/c/d/e/f/g/h"] == "/a/b/c/d/e/f/g/h"


def test_rejected_templates_block_unruled_urls(spark, monkeypatch):
    """A wildcard joins ruled and unruled urls, and merged branches have labels enough; without either nothing is blocked."""
    wild = [(i, f"http://h/m{i}/p") for i in range(60)]
    rules = [("h", f"/m{i}/", "block") for i in range(40)] + [("h", "/fine/", "allow")]
    wild += [(100 + i, "http://h/fine/p") for i in range(8)]
    parts = [(200 + 30 * k + i, f"http://g/{s}/{i}-{s}") for k, s in enumerate("abcdef") for i in range(30)]
    rules += [("g", f"/{s}/{i}-", "block") for s in "abcdef" for i in range(5)] + [("g", "/ok", "allow")]
    parts += [(500 + i, f"http://g/ok/{i}-x") for i in range(60)]
    d = spark.createDataFrame(wild + parts, "page_id long, url string")

    def blocked(host):
        return {r["page_id"] for r in urlfilter.judge(d, rules).filter(f"host = '{host}' and rule is null and verdict = 'block'").collect()}

    assert blocked("h") == set(range(40, 60))
    assert blocked("g") == {i for i, u in parts if i < 500 and not rule_hits(u, rules)}
    monkeypatch.setattr(urlfilter, "APART_KINDS", -1.0)
    assert blocked("g") == set()
    monkeypatch.setattr(urlfilter, "OPEN", 2.0)
    assert blocked("h") == set()


def rule_hits(url, rules):
    h, p = host_path(url)
    return any(h == host and p.startswith(path) for host, path, _ in rules)


# --- language identification ------------------------------------------------


def test_kneser_ney_by_plain_loops():
    """Probabilities sum to one over the alphabet, and equal the textbook recursion."""
    texts = {"x": ["abab", "abba", "aab"], "y": ["bbb", "bab"]}
    counts = {}
    for lang, ws in texts.items():
        g, n = np.unique(langid.windows(ws)[0], return_counts=True)
        counts[lang] = (g, n)
    m = langid.kneser_ney(counts)

    def brute(lang, gram):
        full = {}
        for w in texts[lang]:
            p = "   " + w + " "
            for i in range(3, len(p)):
                full[p[i - 3 : i + 1]] = full.get(p[i - 3 : i + 1], 0) + 1
        p, table = m.uniform, {4: full}
        for n in (3, 2, 1):
            table[n] = {}
            for g in table[n + 1]:
                table[n][g[1:]] = table[n].get(g[1:], 0) + 1
        for n in (1, 2, 3, 4):
            t, g = table[n], gram[4 - n :]
            n1, n2 = (sum(v == k for v in t.values()) for k in (1, 2))
            d = n1 / (n1 + 2 * n2) if n1 and n2 else 0.5
            ctx = {k: v for k, v in t.items() if k[:-1] == g[:-1]}
            total = sum(ctx.values())
            if total:
                p = max(ctx.get(g, 0) - d, 0) / total + sum(min(v, d) for v in ctx.values()) / total * p
        return p

    def code(s):
        return sum(ord(c) << 16 * (3 - i) for i, c in enumerate(s))

    for g in ("   a", "  ab", "abab", "bbb ", "zzzz", "aabz"):
        got = np.exp(m.log_prob(np.array([code(g)], dtype=np.uint64)))[0]
        assert got == pytest.approx([brute("x", g), brute("y", g)], rel=1e-9)
    for ctx in ("   ", " ab", "bab"):
        total = sum(np.exp(m.log_prob(np.array([code(ctx + c)], dtype=np.uint64)))[0] for c in "ab ")
        assert (total + m.uniform * 0 <= 1 + 1e-9).all()


def test_languages(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    extra = [(9000, None, "en"), (9001, "", "en"), (9002, "123 !? 456", None), (None, "the and of with that", "en"), (9003, "the of and is " * 5000, None)]
    docs = docs.select("doc_id", "text", "lang").unionByName(spark.createDataFrame(extra, "doc_id long, text string, lang string")).withColumn("score", F.lit("clash"))
    got = {r["doc_id"]: r for r in langid.identify(docs).collect()}
    truth = {r["doc_id"]: r["lang"] for r in docs.collect()}
    assert [got[i]["lang_pred"] for i in (9000, 9001, 9002)] == ["und"] * 3 and got[9000]["score"] == 0.0
    assert got[9003]["lang_pred"] == got[None]["lang_pred"] == "en" and not got[None]["held_out"]
    held = [r for i, r in got.items() if i is not None and i < 9000 and crc(i) % 5 == 0]
    assert held and all(r["held_out"] for r in held)
    assert np.mean([r["lang_pred"] == truth[r["doc_id"]] for r in held]) >= 0.95
    assert all(0 <= r["score"] <= 1 for r in got.values())
    none = langid.identify(docs.filter("lang is null")).collect()
    assert {r["lang_pred"] for r in none} == {"und"}
    assert langid.identify(docs.limit(0)).count() == 0


def test_every_ngram_is_learned(spark):
    """A large character set: more than 2**18 distinct n-grams, nearly all of them seen once."""
    rng = np.random.default_rng(4)
    texts = ["".join(map(chr, rng.integers(0x4E00, 0x9F00, 1000))) for _ in range(450)]
    docs = spark.createDataFrame([(i, t, "zh") for i, t in enumerate(texts)], "doc_id long, text string, lang string")
    grams = np.unique(langid.windows([t for i, t in enumerate(texts) if crc(i) % 5 > 1])[0])
    assert len(grams) > 1 << 18
    assert set(langid.mix(grams).tolist()) <= set(langid.train(docs).known.tolist())


def test_all_but_the_held_out_fold_is_learned(spark):
    """A language whose texts all lie in the checked fold is known; every language has a limit, from all checked rows."""
    rng = np.random.default_rng(6)
    text = lambda letters: " ".join("".join(rng.choice(list(letters), 5)) for _ in range(30))
    fold = lambda k, n: [i for i in range(40_000) if crc(i) % 5 == k][:n]
    rows = [(i, text("abcde"), "x") for k in (1, 2, 3) for i in fold(k, 40)]
    rows += [(i, text("vwxyz"), "y") for i in fold(4, 40)] + [(i, text("klmno"), "z") for i in fold(1, 60)[40:]]
    rows.append((fold(1, 5001)[-1], text("fghij"), "x"))
    model = langid.train(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    assert model.languages == ["x", "y", "z"] and np.isfinite(model.limits).all()
    e, _ = langid.Scorer(model).entropies([text("klmno"), rows[-1][1]])
    assert e[0].argmin() == 2 and e[1].argmin() == 0


def test_predictions_do_not_read_labels(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text", "lang")
    model = langid.train(docs)
    a = langid.identify(docs, model=model).select("doc_id", "lang_pred").collect()
    b = langid.identify(docs.withColumn("lang", F.lit("xx")), model=model).select("doc_id", "lang_pred").collect()
    assert sorted(map(tuple, a)) == sorted(map(tuple, b))


def test_an_unknown_script_is_rejected(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text", "lang")
    model = langid.train(docs)
    odd = spark.createDataFrame([(1, "ωψξ ζθλ " * 40, None)], "doc_id long, text string, lang string")
    assert langid.identify(odd, model=model).first()["rejected"]


# --- toxicity ---------------------------------------------------------------


def test_toxicity(spark):
    rng = np.random.default_rng(3)
    common = [f"word{k}" for k in range(200)]
    docs, labels = [], []
    for i in range(1200):
        bad = i % 8 == 0
        text = " ".join(rng.choice(common, 40)) + (" you idiot" if bad else "")
        docs.append((i, text, "en"))
        labels.append((i, int(bad), 1))
    docs += [(5000, None, None), (5001, "", None), (None, "an idiot", None), (5002, "fine words", "en"), (5003, ("calm " * 20000) + "idiot", "en")]
    d = spark.createDataFrame(docs, "doc_id long, text string, lang string").withColumn("score", F.lit("clash"))
    lab = spark.createDataFrame([*labels, (3, None, 1), (None, 1, 1), (0, 0, 1)], "doc_id long, toxic int, quality int")
    got = {r["doc_id"]: r for r in toxicity.score_documents(d, lab).collect()}
    for i, bad, _ in labels:
        assert got[i]["predicted"] == bad and got[i]["held_out"] == (crc(i) % 3 == 1)
    assert [got[i]["predicted"] for i in (5000, 5001, 5002, 5003)] == [0, 0, 0, 1] and got[None]["predicted"] == 1 and got[None]["held_out"] is False
    kept = toxicity.clean_documents(d, lab)
    assert kept.columns == d.columns and 5003 not in {r["doc_id"] for r in kept.collect()} and kept.count() == sum(r["predicted"] == 0 for r in got.values())
    assert toxicity.score_documents(d.limit(0), lab).count() == 0
    assert {r["predicted"] for r in toxicity.score_documents(d, lab.limit(0)).collect()} == {0}


def test_swapping_identity_terms_moves_little():
    """A group's term that goes with the label by chance loses its weight to the penalty."""
    x, y, swaps = [], [], []
    rng = np.random.default_rng(0)
    for i in range(400):
        bad = i % 4 == 0
        row = ([0] if bad and rng.random() < 0.7 else []) + ([1] if rng.random() < (0.8 if bad else 0.05) else [])
        x.append(row)
        y.append(float(bad))
        if 1 in row:
            swaps.append((row, [2 if f == 1 else f for f in row]))
    free, _ = toxicity.fit(x, np.array(y), [], 3)
    held, _ = toxicity.fit(x, np.array(y), swaps, 3)
    assert abs(held[1] - held[2]) < 0.25 * abs(free[1] - free[2]) and held[0] > 1


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    docs, lab = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    r = toxicity.score_documents(docs, lab).filter("held_out").join(lab, "doc_id").toPandas()
    a, b = r[r.toxic == 1].score.to_numpy(), r[r.toxic == 0].score.to_numpy()
    assert (a[:, None] > b).mean() + 0.5 * (a[:, None] == b).mean() > 0.85
    assert ((r.predicted == 1) & (r.toxic == 0)).sum() <= 2


def test_counterfactuals_of_every_term():
    groups = [[b"a", b"b", b"c", b"d"], [b"x", b"y"]]
    got = toxicity.counterfactuals({b"a", b"b", b"x", b"other"}, groups)
    assert got == [(b"a", None), (b"a", b"c"), (b"a", b"d"), (b"b", None), (b"b", b"c"), (b"b", b"d"), (b"x", None), (b"x", b"y")]
    assert toxicity.counterfactuals(set(), groups) == []


def test_identity_terms_carry_no_score(spark, monkeypatch):
    """Planted mentions that go with toxic labels: with the penalty a term weighs no more than any other of its group or none at all, without it much."""
    rng = np.random.default_rng(3)
    filler = lambda: " ".join(f"w{x}" for x in rng.integers(0, 400, 30))
    for term, others in (("muslim", ["hindu", "protestant", "atheist"]), ("einwanderer", ["europäer", "afrikaner"]), ("gitanos", ["africanos"]), ("juifs", ["sikhs", "bouddhistes"])):
        rows = [(i, f"{filler()} {term if i % 10 else ''} {'idiot' if i % 3 else 'trash'}", 1) for i in range(120)]
        rows += [(200 + i, f"{filler()} {term if i % 10 == 0 else ''}", 0) for i in range(240)]
        d = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
        lab = spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id long, toxic int")
        gap, alarm = {}, {}
        for swap in (1.0, 0.0) if term == "muslim" else (1.0,):
            monkeypatch.setattr(toxicity, "SWAP", swap)
            m = toxicity.train(d, lab)
            logit = lambda text: m.bias + sum(m.weights[f] for f in m.present(text))  # noqa: B023, E731
            gap[swap] = max(abs(logit(f"we met a {term} neighbour") - logit(f"we met a {o} neighbour")) for o in others)
            alarm[swap] = logit(f"we met a {term} neighbour") - logit("we met a neighbour")
            assert m.score("an idiot and trash") > 0.5
        assert gap[1.0] < 0.3 and abs(alarm[1.0]) < 0.3
        assert min(gap.get(0.0, 9), alarm.get(0.0, 9)) > 1


def test_false_alarms_on_neutral_mentions_fall(spark, monkeypatch):
    """A term in nearly every toxic text and few clean ones: neutral sentences that name any of its group are rejected without the penalty only."""
    rng = np.random.default_rng(5)
    filler = lambda: " ".join(f"w{x}" for x in rng.integers(0, 200, 12))
    bad = ["idiot", "trash", "scum"]
    rows = [(i, f"{filler()} muslim {bad[i % 3] if i % 5 else ''}", 1) for i in range(200)] + [(300 + i, filler() + (" muslim" if i % 40 == 0 else ""), 0) for i in range(300)]
    d = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    lab = spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id long, toxic int")
    alarms = {}
    for swap in (1.0, 0.0):
        monkeypatch.setattr(toxicity, "SWAP", swap)
        m = toxicity.train(d, lab)
        alarms[swap] = sum(m.score(f"{filler()} {t}") >= 0.5 for t in ("muslim", "hindu", "jewish", "sikh") for _ in range(10))
        assert m.score(f"{filler()} muslim idiot scum trash") > 0.5
    assert alarms[1.0] == 0 and alarms[0.0] >= 10


def test_labels_of_equal_texts_and_without_documents(spark):
    """Equal texts with different labels count as toxic, in any order; labels without a document do not use up the sample."""
    texts = [f"w{i % 7} {'idiot' if i % 2 else 'fine'} w{i}" for i in range(80)]
    rows = [(i, t) for i, t in enumerate(texts)] + [(1000 + i, t) for i, t in enumerate(texts)]
    lab = [(i, i % 2) for i in range(80)] + [(1000 + i, 0) for i in range(80)]
    d = spark.createDataFrame(rows, "doc_id long, text string")
    models = [toxicity.train(d.orderBy(F.col("doc_id") * s), spark.createDataFrame(lab[::s], "doc_id long, toxic int"), folds=1) for s in (1, -1)]
    assert models[0] == models[1] and models[0].score("w3 idiot") > 0.5 > models[0].score("w3 fine")
    ghosts = spark.createDataFrame([(10_000 + i, 1) for i in range(500)] + lab, "doc_id long, toxic int")
    assert toxicity.train(d, ghosts, folds=1, sample=200) == models[0]


def test_fit_by_plain_loops():
    """The loss of plain loops has no slope at the weights found."""
    rng = np.random.default_rng(1)
    x = [sorted(set(rng.integers(0, 6, 3).tolist())) for _ in range(50)]
    y = np.array([1.0 if 0 in r or rng.random() < 0.2 else 0.0 for r in x])
    swaps = [(r, sorted({1 if f == 0 else f for f in r})) for r in x if 0 in r]

    def loss(w, b):
        out = toxicity.RIDGE / 2 * sum(v * v for v in w)
        for r, t in zip(x, y, strict=True):
            z = b + sum(w[f] for f in r)
            out += np.log1p(np.exp(-z)) if t else np.log1p(np.exp(z))
        return out + toxicity.SWAP * sum((sum(w[f] for f in r) - sum(w[f] for f in o)) ** 2 for r, o in swaps)

    w, b = toxicity.fit(x, y, swaps, 6, steps=20_000)
    for k in range(7):
        step = np.zeros(7)
        step[k] = 1e-5
        assert abs(loss(w + step[:6], b + step[6]) - loss(w - step[:6], b - step[6])) / 2e-5 < 1e-3


# --- decontamination --------------------------------------------------------


def greedy(item, doc, least):
    """Greedy string tiling as published: the longest unmarked match, again and again."""
    mi, md, out = [False] * len(item), [False] * len(doc), []
    while True:
        best = None
        for i in range(len(item)):
            for j in range(len(doc)):
                n = 0
                while i + n < len(item) and j + n < len(doc) and item[i + n] == doc[j + n] and not mi[i + n] and not md[j + n]:
                    n += 1
                if n >= least and (best is None or n > best[0]):
                    best = (n, i, j)
        if best is None:
            return out
        n, i, j = best
        mi[i : i + n] = md[j : j + n] = [True] * n
        out.append(best)


def test_tiles_by_plain_loops():
    rng = np.random.default_rng(5)
    for _ in range(60):
        item, doc = rng.integers(1, 4, 18).tolist(), rng.integers(1, 4, 40).tolist()
        seeds = [(i, j) for i in range(16) for j in range(38) if item[i : i + 3] == doc[j : j + 3]]
        assert sorted(decontam.tiles(item, doc, seeds, 3)) == sorted(greedy(item, doc, 3))


ITEM = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu"


def test_contaminated_documents(spark):
    w = ITEM.split()
    moved = " ".join(w[6:]) + " middle words of another kind " + " ".join(w[:6])
    docs = [(1, f"before, {ITEM.upper()}! after"), (2, moved), (3, " ".join(w[:5])), (4, "nothing of it"), (5, None), (6, ""), (None, ITEM), (7, "x " * 50000 + ITEM), (1, f"before, {ITEM.upper()}! after"), (8, "It is Too - short!")]
    bench = [(10, ITEM), (11, "too short"), (12, None), (None, "one two three four five six"), (13, ITEM)]
    d = spark.createDataFrame(docs, "doc_id long, text string").withColumn("item_id", F.lit("clash")).withColumn("coverage", F.lit(1))
    b = spark.createDataFrame(bench, "item_id long, text string")
    for chars in (1 << 20, 40):  # one block, several blocks
        got = decontam.contaminated_pairs(d, b, block_chars=chars).collect()
        assert sorted([(r["doc_id"], r["item_id"]) for r in got], key=str) == sorted([(8, 11), *((i, k) for i in (1, 1, 2, 7, None) for k in (10, 13))], key=str)
        assert {r["n_tiles"] for r in got if r["doc_id"] == 2} == {2}
        kept = decontam.clean_documents(d, b, block_chars=chars)
        assert kept.columns == d.columns and sorted(r["doc_id"] for r in kept.collect()) == [3, 4, 5, 6]
    assert decontam.contaminated_pairs(d, b.limit(0)).count() == 0 and decontam.contaminated_pairs(d.limit(0), b).count() == 0


def test_url_templates_have_no_last_level(spark):
    """Urls that differ in the 19th segment have templates of their own, those of one node are still judged together."""
    from mnemora.llm import urlfilter

    deep = "/" + "/".join(["d"] * 18)
    rules = [("h.com", deep + "/bad/", "block"), ("h.com", deep + "/good/", "allow")]
    urls = [f"http://h.com{deep}/{k}/x/y" for k in ("bad", "good")] + [f"http://h.com{deep}/bad/x/y?{i}" for i in range(30)] + [f"http://h.com{deep}/good/x/y?{i}" for i in range(30)] + ["http://h.com/" + "/".join(map(str, range(40))), "http://h.com"]
    got = {r["path"]: r["template"] for r in urlfilter.judge(spark.createDataFrame(list(enumerate(urls)), "page_id long, url string"), rules).collect()}
    assert got[deep + "/bad/x/y"] == "h.com" + deep + "/bad/x/y" and got[deep + "/good/x/y"] == "h.com" + deep + "/good/x/y"
    assert "**" not in "".join(got.values()) and len(got) == 4
