"""Source divergence, tokenizer alignment and secret scans against plain Python and SQL on odd rows."""

import hashlib
import random
import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from folioforge.llm import alignment, credentials, divergence, oracles, queries
from tests.oracle import SF, same

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


@pytest.fixture(scope="module")
def files():
    return queries.tokenizer("byte_bpe_50k.json"), queries.tokenizer("piece_bpe_32k.model"), queries.tokenizer("byte_bpe_50k.tiktoken")


# ---------------------------------------------------------------- 11
def brute_audit(rows, least):
    docs = [(lang or "", source or "", re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", (text or "").translate(LOWER))) for lang, source, text in rows]
    held, counts, totals = defaultdict(Counter), defaultdict(Counter), defaultdict(Counter)
    for lang, source, words in docs:
        held[lang].update(set(words))
        counts[lang, source].update(words)
        totals[lang].update(words)
    out = set()
    for lang in {d[0] for d in docs}:
        kept = [t for t, n in held[lang].items() if n >= least]

        def shares(c, kept=kept):
            total = sum(c[t] for t in kept) + 2 * len(kept)
            return {t: 1 + 10**9 * (c[t] + 2) // total for t in kept}

        f = lambda p, q: (p - q) ** 2 // (p + q)
        mine = {s: shares(counts[lang, s]) for ln, s in counts if ln == lang}
        whole = shares(totals[lang])
        for s, p in mine.items():
            pairs = [(o, sum(f(p[t], q[t]) for t in kept)) for o, q in mine.items() if o != s]
            terms = [(t, f(p[t], whole[t])) for t in kept if counts[lang, s][t] and p[t] > whole[t]]
            for part, items, top in (("pair", pairs, None), ("term", terms, 10)):
                ranked = sorted(items, key=lambda x: (-x[1], x[0].encode()))[:top]
                out |= {(lang, s, part, i, v, k + 1) for k, (i, v) in enumerate(ranked)}
    return out


def audit_rows():
    rnd = random.Random(5)
    words = "Alpha beta gamma Straße ÉTÉ 日本 été delta x1y ﬀ ‿a".split()
    rows = [(f"l{rnd.randrange(2)}", f"s{rnd.randrange(7)}", " ".join(rnd.choices(words, k=rnd.randrange(12)))) for _ in range(300)]
    rows += [(None, None, "alpha alpha"), ("", "", "beta"), ("l0", None, None), ("l0", "quiet", "12 34 !"), ("alone", "one", "word"), ("none", "a", ""), ("none", "b", None)]
    return rows + rows[:20] + [("l1", "long", "gamma " * 60000)]


@pytest.mark.parametrize("small", [False, True])
def test_divergence_brute_force(spark, monkeypatch, small):
    if small:  # many blocks, chunks and hand-overs
        monkeypatch.setattr(divergence, "BLOCK", 2)
        monkeypatch.setattr(divergence, "CHUNK", 2)
        monkeypatch.setattr(divergence, "HELD", 5)
    rows = audit_rows()
    docs = spark.createDataFrame([(*r, 1, "z") for r in rows], "lang string, source string, text string, n int, term string")
    got = [tuple(r) for r in divergence.audit(docs).collect()]
    assert len(got) == len(set(got)) and set(got) == brute_audit(rows, 10)
    if small:
        records = divergence.tile_records(divergence.Counts(docs, "lang", "source", "text"))
        assert records.filter("i <> j").count() and records.agg(F.max(F.size("cells"))).first()[0] < 40


def test_divergence_is_exact_for_large_counts():
    import numpy as np

    total = 3 * 10**15 + 7
    counts = np.array([0, 1, 10**15, total - 2], np.int64)
    assert divergence.share(counts, total).tolist() == [1 + 10**9 * (int(c) + 2) // total for c in counts]


def test_divergence_of_an_empty_table(spark):
    empty = spark.createDataFrame([], "lang string, source string, text string")
    assert divergence.audit(empty).collect() == []
    assert divergence.audit(empty).columns == ["lang", "source", "part", "item", "value", "rank"]


# ---------------------------------------------------------------- 12
ODD_TEXTS = [
    None, "", " ", "  ", "a", "a  b", "a   b ", " lead", "tail  ", "tab\t\tx \n y\n\n z", "▁under", "x▁", "naïve café", "日本語 テキスト", "😀 ok 😀😀",
    "<s> </s> <unk> <0x41>", "<|endoftext|> <|endoftext|>", "  nb sp", "\x00 nul\x00", "it's we'll 'S 've", "1234567 12 3,4.5", "é́ ́", "ß" * 300,
    "word " * 3000, "longunit" * 2000, "the the the of the", "▁▁", "﻿bom", "a b c\u0085d",
]


def brute_alignment(rows, files):
    pair = alignment.Pair(files[0], files[1], None)
    found, counts = [], Counter()
    for key, text in rows:
        a = pair.a.encode(" " + text, add_special_tokens=False).ids if text else []
        b = pair.b.encode(text) if text else []
        whole = (" " + (text or "")).encode()
        if b"".join(pair.a_bytes[i] for i in a) != whole or b"".join(pair.b_bytes[i] for i in b) != whole:
            found.append((key, [], [], [], []))
            continue
        spans = []
        for ids, table in ((a, pair.a_bytes), (b, pair.b_bytes)):
            at, out = 0, []
            for i in ids:
                out.append((at, at + len(table[i]), i))
                at += len(table[i])
            spans.append(out)
        links, lo = [], 0
        for s, e, i in spans[0]:
            while spans[1][lo][1] <= s:
                lo += 1
            k = lo
            while k < len(spans[1]) and spans[1][k][0] < e:
                links.append((i, spans[1][k][2]))
                k += 1
        cuts = sorted({e for _, e, _ in spans[0]} & {e for _, e, _ in spans[1]})
        groups = []
        for s, e in zip([0, *cuts], cuts, strict=False):
            groups.append("|".join(",".join(str(i) for x, y, i in side if s <= x and y <= e) for side in spans))
        counts.update(links)
        found.append((key, a, b, groups, links))
    best = defaultdict(int)
    for (_, b), n in counts.items():
        best[b] = max(best[b], n)
    return sorted(
        (key, len(a), len(b), len(g), len(li), sum(counts[x] == best[x[1]] for x in li), sum(counts[x] for x in li),
         hashlib.sha256(";".join(g).encode()).hexdigest() if g else "")
        for key, a, b, g, li in found
    )


@pytest.mark.parametrize("small", [False, True])
def test_alignment_brute_force(spark, monkeypatch, files, small):
    if small:
        monkeypatch.setattr(alignment, "STRIPE_LINKS", 50)
        monkeypatch.setattr(alignment, "SLICE_LINKS", 7)
        monkeypatch.setattr(alignment, "HELD_PAIRS", 100)
    rnd = random.Random(3)
    pool = ["the", "of", "Straße", "日本", "x", "\n", "\t", "'s", "42", "😀", " ", "http://a.b/c?d=1", "▁", ""]
    texts = ODD_TEXTS + [" ".join(rnd.choices(pool, k=rnd.randrange(9))) for _ in range(150)]
    rows = list(enumerate(texts)) + [(3, "the same id"), (3, "the same id")]
    docs = spark.createDataFrame([(*r, 7, "clash") for r in rows], "doc_id long, text string, n_a int, stripe string").repartition(3)
    got = sorted(tuple(r) for r in alignment.annotate(docs, files).collect())
    assert got == brute_alignment(rows, files)


def test_alignment_keeps_columns_and_null_ids(spark, files):
    docs = spark.createDataFrame([(None, "one two", "de"), (None, None, None), (4, "one", "en")], "doc_id long, text string, lang string")
    got = alignment.annotate(docs, files, "lang")
    assert got.columns[:2] == ["doc_id", "lang"] and sorted((r.doc_id or 0, r.lang or "", r.n_a) for r in got.collect()) == [(0, "", 0), (0, "de", 2), (4, "en", 1)]
    assert alignment.annotate(docs.limit(0), files).collect() == []


def test_quick_encoder_agrees(files):
    """The table of ranks gives the tokenizer file's ids for every character that it is used for, in company."""
    pair, slow = alignment.Pair(*files), alignment.Pair(files[0], files[1], None)
    chars = [chr(i) for i in range(0x250) if chr(i) != " "]
    units = [f" {c}" for c in chars] + [f" a{c}b1{c}2{c}{c}" for c in chars] + [f" {c}'s{d}\n{c}" for c in chars for d in "a1.\t"]
    rnd = random.Random(1)
    units += [" " + "".join(rnd.choices(chars, k=rnd.randrange(1, 12))) for _ in range(20000)]
    assert pair.encode(units)[0] == slow.encode(units)[0]


def test_units_give_the_whole_texts_ids(files):
    units = alignment.Units(alignment.Pair(*files))
    docs = [r for r in ODD_TEXTS if r]
    for text, places in zip(docs, units.of(docs), strict=True):
        a = units.pair.a.encode(" " + text, add_special_tokens=False).ids
        b = units.pair.b.encode(text)
        n = units.facts[places].sum(axis=0)
        assert "▁" in text or (len(a), len(b)) == (n[1], n[2])


# ---------------------------------------------------------------- 13
KEY = "AKIA" + "QWERTYUIOP123456"
STRONG = "Zx9Kq2Lm7Pw4Rt6Yv1Bn"
ODD_SECRETS = [
    (1, None, "a/x"), (2, "", "a/x"), (3, "nothing here", None), (4, f"id {KEY} and {KEY}{KEY}", "a/x"), (5, "AKIA AKIA1 AKIASHORT", "a/y"),
    (6, "password=short secret: token: abcdefgh1", "b/x"), (7, "Token==abcdefgh api-key=abcdefgh1 api_key = 'abcd/+=_.-1'", "b/y"),
    (8, "PASSWORD\n=abcdefgh1 passwd  :  \"abcdefgh1", "c"), (9, "f" * 31 + " " + "0a" * 16 + " " + "F" * 40 + "9" * 33, "c"),
    (10, f"é😀 secret={STRONG} 日本 {'ab' * 20}", "d/one"), (11, f"bare {STRONG}", "d/two"), (12, f"bare {STRONG}", "D/three"), (13, f"alone {STRONG[::-1]}", None),
    (14, "lowercase_words_only_1_but_long_and_plain", "e"), (15, " ".join(f"key{i}=Aa{i:018d}Bb" for i in range(2000)), "f"), (16, f"x{KEY}y", "g"),
    (17, "my_very_long_prefix_1_password=abcdefgh9_and_more_than_sixteen1", "h"), (18, "token=" + "A1b2" * 5000, "h"), (None, f"secret={STRONG}", "i"), (None, None, None),
    (19, "copied Qq1Ww2Ee3Rr4Tt5Yy6Uu", "o1/a"), (20, "copied Qq1Ww2Ee3Rr4Tt5Yy6Uu", "o2/a"), (21, "copied Qq1Ww2Ee3Rr4Tt5Yy6Uu", "o3/a"), (21, "copied Qq1Ww2Ee3Rr4Tt5Yy6Uu", "o3/a"),
    (22, "twice Qq1Ww2Ee3Rr4Tt5Yy6Vv", "o1/a"), (23, "twice Qq1Ww2Ee3Rr4Tt5Yy6Vv", "o1/b"), (24, "twice Qq1Ww2Ee3Rr4Tt5Yy6Vv", "o2/b"),
]


def secret_docs(spark):
    return spark.createDataFrame([(i, t, s, 1, "x") for i, t, s in ODD_SECRETS], "doc_id long, text string, source string, kind int, value string")


def brute_secrets():
    assign = re.compile(r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII)
    spans, owners, known = [], defaultdict(set), set()
    for key, text, source in ODD_SECRETS:
        text, mine = text or "", []
        for m in assign.finditer(text):
            if len(m[1]) >= 8:
                mine.append((m.start(), 0, m.end(), m[1]))
                known.add(m[1])
        mine += [(m.start(), 1, m.end(), m[0]) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 16]
        mine += [(m.start(), 2, m.end(), m[0]) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 32]
        blanked = assign.sub(lambda m: "\n" * len(m[0]), text)
        for m in re.finditer("[A-Za-z0-9+/_-]{16,}", blanked):
            if re.search("[0-9]", m[0]) and re.search("[A-Za-z]", m[0]) and not re.search("AKIA[A-Z0-9]{12}|[0-9a-f]{32}", m[0]):
                mine.append((m.start(), 3, m.end(), m[0]))
        for x in mine:
            owners[x[3]].add(None if source is None else source.split("/")[0].lower())
        spans.append((key, mine))

    def live(v):
        return v in known or (len(v) >= 20 and re.search("[a-z]", v) and re.search("[A-Z]", v) and len(set(v)) >= 10)

    out = []
    for key, mine in spans:
        kept = sorted(x for x in mine if x[1] < 3 or (len(owners[x[3]]) <= 2 and live(x[3])))
        out.append((key, [(s, credentials.KINDS[k], e) for s, k, e, _ in kept], sum(len(owners[x[3]]) <= 2 for x in kept)))
    return sorted(out, key=str)


def test_secrets_brute_force(spark):
    got = credentials.annotate(secret_docs(spark)).collect()
    assert sorted([(r.doc_id, [(x.start, x.kind, x.end) for x in r.found], r.n_live) for r in got], key=str) == brute_secrets()
    owned = {r.doc_id for r in got if any(x.kind == "owned" for x in r.found)}
    assert {11, 12, 22, 23, 24} <= owned and not {19, 20, 21} & owned  # one owner's, a mirror's; an example of three
    assert all(len(r.found) == r.n_live + r.n_example for r in got)


def test_secrets_twin_on_odd_rows(spark, tmp_path):
    secret_docs(spark).write.parquet(f"{tmp_path}/documents.parquet")
    import duckdb  # the folder holds part files

    con = duckdb.connect()
    rows = con.sql(f"SELECT count(*) FROM '{tmp_path}/documents.parquet/*.parquet'").fetchall()
    assert rows == [(len(ODD_SECRETS),)]
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    rel = con.sql(oracles.OP13)
    got = queries.op13_secret_scan(spark, str(tmp_path))
    assert sorted(got.columns) == sorted(rel.columns)
    assert sorted(map(str, (tuple(r) for r in got.select(rel.columns).collect()))) == sorted(map(str, rel.fetchall()))


def test_secrets_ownership_decides(spark):
    """With every document's source the same owner's, the copied value is reported; with none shared, no base span goes."""
    docs = secret_docs(spark)
    one = credentials.annotate(docs.withColumn("source", F.lit("same")))
    assert {19, 20, 21} <= {r.doc_id for r in one.collect() if any(x.kind == "owned" for x in r.found)}
    many = credentials.annotate(docs.withColumn("source", F.concat("source", F.lit("/"), F.col("doc_id"))))
    base = lambda df: sorted((r.doc_id or 0, x.start, x.kind) for r in df.collect() for x in r.found if x.kind != "owned")
    assert base(one) == base(many)


def test_secrets_are_native(spark):
    plan = credentials.annotate(secret_docs(spark))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_secrets_of_an_empty_table_and_a_hot_value(spark, monkeypatch):
    from folioforge.llm import shared

    assert credentials.annotate(secret_docs(spark).limit(0)).collect() == []
    monkeypatch.setattr(shared, "BROADCAST_ROWS", 0)
    monkeypatch.setattr(shared, "HOT_LEAST", 3)
    hot = spark.range(900).select(F.col("id").alias("doc_id"), F.concat(F.lit(f"key {KEY} "), F.lit("word " * 3)).alias("text"), F.concat(F.lit("o"), F.col("id") % 3).alias("source"))
    got = credentials.annotate(hot).collect()
    assert len(got) == 900 and all([(x.start, x.kind) for x in r.found] == [(4, "access")] and r.n_example == 1 for r in got)


@pytest.mark.parametrize("name", ["op11_source_divergence", "op13_secret_scan"])
def test_twins_at_another_scale(spark, name):
    same(spark, queries.queries()[name], oracles.oracle_sql()[name], sf=SF.replace("0.001", "0.01"))
