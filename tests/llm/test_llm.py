import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from folioforge.llm import decontaminate, html_text, jaccard, language, lengths, mixing, oracles, phrases, quality, queries, shared, urls, wavelet
from tests.llm import brute
from tests.oracle import SF, same

ODD = [
    (1, None), (2, ""), (3, "   \n\t "), (4, "one"), (5, "One two three"), (6, "a b c d e f g h i j k l m n o p q r s t"),
    (7, "a b c d e f g h i j k l m n o p q r s t"), (8, "A b c d e f g h i j k l m n o p q r s u"), (9, "x" * 700), (10, "ab" * 300 + "é" * 90),
    (11, "word " * 3000), (12, "naïve café 你好 世界 " * 40), (13, "naïve café 你好 世界 " * 40), (14, "\u00a0"), (15, "q" * 199),
]


def frame(spark, rows=ODD):
    return spark.createDataFrame(rows, "doc_id long, text string")


def documents(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


def pairs(df):
    return [tuple(r) for r in df.select("doc_id", "text").collect()]


@pytest.mark.parametrize("name", sorted(oracles.oracle_sql()))
def test_twin(spark, name):
    same(spark, queries.queries()[name], oracles.oracle_sql()[name])


# ---------------------------------------------------------------- 1
def test_decontamination_brute_force(spark):
    bench = spark.read.parquet(f"{SF}/benchmark.parquet")
    extra = [(900, "zq one two"), (901, ""), (902, "solo"), (903, None), (900, "other text of the same id now")]
    bench = bench.unionByName(spark.createDataFrame(extra, "item_id long, text string"))
    docs = documents(spark).select("doc_id", "text").union(frame(spark, [(1000, "ZQ, one; two! SOLO"), (1001, None), (1002, "two zq one zq one two")]))
    want = brute.decontaminate(pairs(docs), [tuple(r) for r in bench.select("item_id", "text").collect()])
    got = {r.doc_id: (r.n_words, r.n_hit, r["items"]) for r in decontaminate.annotate(docs, bench).collect()}
    assert got == want and got[1000] == (4, 4, ["900", "902"])


def test_decontamination_in_blocks(spark, monkeypatch):
    bench = spark.read.parquet(f"{SF}/benchmark.parquet")
    one = sorted(decontaminate.annotate(documents(spark), bench).collect())
    assert any(r.n_hit for r in one)
    counted = []
    true = decontaminate.token_counts
    monkeypatch.setattr(decontaminate, "token_counts", lambda *a: counted.append(1) or true(*a))
    monkeypatch.setattr(decontaminate, "BLOCK_WINDOWS", 3)
    blocks = decontaminate.index(documents(spark), bench)
    assert len(blocks) >= 20 and counted == [1]  # one scan counts for all blocks
    assert sorted(decontaminate.annotate(documents(spark), bench).collect()) == one
    monkeypatch.setattr(decontaminate, "_SLICE", 3)
    monkeypatch.setattr(decontaminate, "BUFFER_BYTES", 1)
    assert sorted(decontaminate.annotate(documents(spark), bench).collect()) == one
    clean = {r.doc_id for r in decontaminate.clean(documents(spark), bench).collect()}
    assert clean == {r.doc_id for r in one if not r.n_hit}


def test_decontamination_of_long_texts_and_items(spark):
    words = [f"w{i}" for i in range(60_000)]
    docs = [(1, " ".join(words)), (2, None), (3, "no such words " * 20_000), (4, " ".join(words[30_000:30_009]))]
    bench = [("long", " ".join(words[10_000:40_000])), (None, "w7 w8 w9"), ("none", "!!")]
    want = brute.decontaminate(docs, [("" if k is None else k, t) for k, t in bench])
    got = decontaminate.annotate(frame(spark, docs), spark.createDataFrame(bench, "item_id string, text string"))
    assert {r.doc_id: (r.n_words, r.n_hit, r["items"]) for r in got.collect()} == want


def test_decontamination_edges(spark):
    none = spark.createDataFrame([], "item_id long, text string")
    assert all(r.n_hit == 0 for r in decontaminate.annotate(frame(spark), none).collect())
    assert decontaminate.annotate(frame(spark, []), none).count() == 0
    clash = frame(spark).withColumn("items", F.lit(1)).withColumn("n_hit", F.lit("x"))
    bench = spark.createDataFrame([(1, "one two three")], "item_id long, text string")
    kept = decontaminate.clean(clash, bench)
    assert kept.columns == clash.columns and {r.doc_id for r in kept.collect()} == {k for k, _ in ODD} - {5}


# ---------------------------------------------------------------- 2, 4
def _tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(queries.tokenizer())


HARD = ["ÀÉÎ déjà-vu, «né» ß straße… a\x1cb don't it's. 'quoted' x<|endoftext|>y. <|startoftext|>. 12.5, a!. é   naïveİ ÷ñ×", "…,.", "ﬁ Ǆ ͅ ς Σ. 你好，世界。", "it''s, 's 't. l'été. o'clock #tag### $$$ a.b,c.", "re\u0301sume\u0301 e\u0301."]


def test_token_output_brute_force(spark):
    docs = documents(spark).select("doc_id", "text").union(frame(spark, [(-5, HARD[0]), (10**12, None), (10**12 + 1, HARD[3])]))
    files = wavelet.write(docs, queries.tokenizer(), range_docs=37, shard_tokens=9000)
    assert files.count() > 4
    got = {r.doc_id: (r.start, r.n_tokens, r.x) for r in wavelet.read(files, wavelet.crc32, "x").collect()}
    tok, at, want = _tokenizer(), 0, {}
    for key, text in sorted(pairs(docs)):
        ids = tok.encode(text or "", add_special_tokens=False).ids + [1]
        want[key] = (at, len(ids), brute.crc(ids))
        at += len(ids)
    assert got == want


def test_word_encoder_equals_the_tokenizer():
    import pyarrow as pa

    tok, enc = _tokenizer(), wavelet.encoder(queries.tokenizer())
    for t in HARD + [t or "" for _, t in ODD]:
        assert enc.encode(pa.array([t]))[0].tolist() == tok.encode(t, add_special_tokens=False).ids, t


def test_added_tokens_keep_their_case():
    import pyarrow as pa

    tok, enc = _tokenizer(), wavelet.encoder(queries.tokenizer())
    for t in ["A <|ENDOFTEXT|> B", "x<|StartOfText|>Y. <|startoftext|> <|endoftext|>Z", "<|EndOfText|>", "<|X|> É<|ENDOFTEXT|>é"]:
        assert enc.encode(pa.array([t]))[0].tolist() == tok.encode(t, add_special_tokens=False).ids, t


def test_word_encoder_equals_the_tokenizer_on_marks_and_odd_text():
    import random
    import unicodedata

    import pyarrow as pa

    tok, enc, rng = _tokenizer(), wavelet.encoder(queries.tokenizer()), random.Random(5)
    assert enc.known
    # What the encoder builds on: NFC joins ASCII letters with U+0300 to U+036F only.
    pairs_ = [d.split() for c in range(0x110000) if (d := unicodedata.decomposition(chr(c))) and not d.startswith("<")]
    assert all(0x300 <= int(p[1], 16) <= 0x36F for p in pairs_ if len(p) == 2 and int(p[0], 16) < 128)
    ascii_, marks = [chr(c) for c in range(1, 128)], [chr(c) for c in [*range(0x300, 0x370), 0x591, 0x5B0, 0x1DC0, 0x20D0, 0x3099]]
    any_ = [chr(c) for c in range(128, 0x30000, 7) if not 0xD800 <= c < 0xE000]
    odd = ["'s", "'LL", "<|", "<|endoftext|>", "<|EndOfText|>", "T\u0308", "J\u030c", "H\u0331", "W\u030a", "É", "\u212a\u0327", "\u0344"]
    for _ in range(8000):
        t = "".join(rng.choice(rng.choice([ascii_, ascii_, marks, any_, odd])) for _ in range(rng.randint(1, 14)))
        assert enc.encode(pa.array([t]))[0].tolist() == tok.encode(t, add_special_tokens=False).ids, ascii(t)


def test_unknown_tokenizers_encode_whole_texts():
    import pyarrow as pa
    from tokenizers import Tokenizer

    path = queries.tokenizer("byte_bpe_50k.json")
    tok, enc = Tokenizer.from_file(path), wavelet.WordEncoder(path)
    assert not enc.known
    texts = ["Two  spaces, and T\u0308. \n\n", None, "", "<|endoftext|> x"]
    ids, begin = enc.encode(pa.array(texts))
    assert [ids[a:b].tolist() for a, b in zip(begin, begin[1:])] == [tok.encode(t or "", add_special_tokens=False).ids for t in texts]


def test_encoding_a_batch_equals_encoding_each_text():
    import pyarrow as pa

    tok, enc = _tokenizer(), wavelet.encoder(queries.tokenizer())
    texts = [" Two  words\n", None, "T\u0308 A", "", "<|endoftext|> X", "x<|Y", "J\u030c", "plain again, plain", None, " "]
    for some in (texts, texts[:1], texts[2:3], texts[4:7], [], [None], texts[::-1]):
        ids, begin = enc.encode(pa.array(some, pa.string()))
        assert [ids[a:b].tolist() for a, b in zip(begin, begin[1:])] == [tok.encode(t or "", add_special_tokens=False).ids for t in some]


def test_token_files_outlive_the_session(spark, tmp_path):
    import subprocess
    import sys

    path = f"file://{tmp_path}/tokens"
    out = wavelet.write(frame(spark), queries.tokenizer(), path)
    want = sorted(map(tuple, wavelet.read(out, wavelet.crc32, "x").collect()))
    code = f"""
from pyspark.sql import SparkSession
from folioforge.llm import wavelet
spark = SparkSession.builder.master("local[1]").config("spark.ui.enabled", "false").getOrCreate()
print("GOT", sorted(map(tuple, wavelet.read(wavelet.files(spark, {path!r}), wavelet.crc32, "x").collect())))"""
    said = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, timeout=120, cwd=__file__.rsplit("/tests/", 1)[0])
    assert f"GOT {want}" in said.stdout, said.stderr[-2000:]


def test_broken_shards_and_string_ids_are_refused(spark):
    file = wavelet.encode_shard(np.arange(70_000, dtype="<u4"), np.array([70_000]))
    for bad in (b"", b"FFWM", file[:20], file[:100], file[:-1], file + b"x", b"X" + file[1:]):
        with pytest.raises(ValueError):
            wavelet.Shard(bad)
    words = frame(spark).withColumn("doc_id", F.concat(F.lit("a"), F.col("doc_id").cast("string")))
    for f in (lambda d: wavelet.write(d, queries.tokenizer()), jaccard.classes, jaccard.one_of_each, phrases.remove):
        with pytest.raises(TypeError):
            f(words)


def test_very_long_texts_are_encoded_whole(spark):
    long = "Word, naïve T\u0308o 12.5 end. " * 30_000
    docs = frame(spark, [(1, long), (2, long), (3, "x" * 400_000)])
    tok = _tokenizer()
    want = {k: brute.crc(tok.encode(t, add_special_tokens=False).ids + [1]) for k, t in ((1, long), (2, long), (3, "x" * 400_000))}
    assert {r.doc_id: r.x for r in wavelet.read(wavelet.write(docs, queries.tokenizer()), wavelet.crc32, "x").collect()} == want
    hist = lengths.histogram(lengths.encoded_lengths(docs, queries.tokenizer())).collect()
    assert sorted((r.length, r.n_docs) for r in hist)[-1][1] == 2


@pytest.mark.parametrize("n,top", [(0, 10), (1, 1), (5, 2), (70_000, 49_000), (200_000, 90_000)])
def test_wavelet_matrix(n, top):
    rng = np.random.default_rng(n)
    ids = (rng.zipf(1.4, n) % top).astype("<u4")
    shard = wavelet.Shard(wavelet.encode_shard(ids, np.array([n])))
    assert (shard.decode() == ids).all() and shard.counts.tolist() == [n]
    for i in rng.integers(0, n, 20) if n else ():
        assert shard.access(int(i)) == ids[i] and shard.rank(int(ids[i]), int(i)) == (ids[:i] == ids[i]).sum()
    for c in {0, 1, 2, top - 1, top + 5, 1 << 20}:
        at = np.flatnonzero(ids == c)
        assert shard.count(c) == len(at)
        for k in {0, len(at) // 2, len(at) - 1} if len(at) else ():
            assert shard.select(c, k) == at[k]
        with pytest.raises(IndexError):
            shard.select(c, len(at))
    with pytest.raises(IndexError):
        shard.access(n)


def test_token_output_edges(spark):
    path = queries.tokenizer()
    assert wavelet.read(wavelet.write(frame(spark, []), path), wavelet.crc32, "x").count() == 0
    same_id = frame(spark, [(7, f"text number {i}") for i in range(40)] + [(None, "a"), (None, None)])
    got = wavelet.read(wavelet.write(same_id.withColumn("shard", F.lit(1)), path, range_docs=5), wavelet.crc32, "x").orderBy("start").collect()
    assert [r.doc_id for r in got] == [None, None] + [7] * 40
    assert [r.start for r in got[1:]] == np.cumsum([r.n_tokens for r in got])[:-1].tolist()


def test_length_histogram(spark):
    docs = documents(spark).select("doc_id", "text").union(frame(spark))
    n = sorted(len(e.ids) for e in _tokenizer().encode_batch([t or "" for _, t in pairs(docs)], add_special_tokens=False))
    hist = lengths.histogram(lengths.encoded_lengths(docs, queries.tokenizer()))
    for r in hist.collect():
        over = [x for x in n if x >= r.length]
        assert (r.n_docs, r.docs_at_least, r.tokens_at_least, r.truncated_tokens) == (n.count(r.length), len(over), sum(over), sum(min(x, r.length) for x in n))
    asked = [0, 1, 2, 99, 100, 255, 256, 257, 5000, 10**6, *{x + d for x in n[::7] for d in (-1, 0, 1)}]
    limits = spark.createDataFrame([(x,) for x in [*asked, 100, None]], "context_limit long")
    plan = lengths.at_limits(hist, limits)
    assert "CartesianProduct" not in plan._jdf.queryExecution().toString()
    got = {r.context_limit: (r.docs_over, r.tokens_over, r.tokens_kept) for r in plan.collect()}
    want = {c: (sum(x > c for x in n), sum(x for x in n if x > c), sum(min(x, c) for x in n)) for c in asked}
    assert got == want | {None: (None, None, None)}
    none = lengths.histogram(lengths.encoded_lengths(frame(spark, []), queries.tokenizer()))
    assert lengths.quantile(none, 0.5).first().length is None
    assert lengths.at_limits(none, limits).filter("context_limit = 100").first()[1:] == (0, 0, 0)
    for q in (0.0, 0.5, 0.9, 1.0):
        assert lengths.quantile(hist, q).first().length == n[max(0, int(np.ceil(q * len(n))) - 1)]
    assert lengths.histogram(lengths.encoded_lengths(frame(spark, []), queries.tokenizer())).count() == 0


# ---------------------------------------------------------------- 3
def test_language_held_out_accuracy(spark):
    from folioforge.llm.queries import op3_language_id

    got = op3_language_id(spark, SF.replace("0.001", "0.01")).join(spark.read.parquet(f"{SF.replace('0.001', '0.01')}/documents.parquet").select("doc_id", "lang"), "doc_id")
    rows = got.filter("held_out").collect()
    assert len(rows) > 150 and sum(r.lang == r.lang_pred for r in rows) >= 0.99 * len(rows)
    assert all(0 <= r.score <= 1 for r in rows)


def test_language_edges(spark):
    train = spark.createDataFrame(
        [(i, t, g) for i in range(40) for t, g in (("the cat and the dog are here with you " * (1 + i % 3), "en"), ("der hund und die katze sind nicht hier " * (1 + i % 3), "de"), ("le chien et la table sont dans une rue " * 2, "fr"), ("el perro y la mesa son de los otros " * 2, "es"))]
        + [(None, "x", "en"), (5, "y", None), (6, None, "fr")],
        "doc_id long, text string, lang string",
    )
    model = language.train(train)
    texts = [(1, "the dog and the cat", "zz"), (2, "die katze und der hund", "zz"), (3, "la table et le chien", None), (4, "el perro y los otros", "en"), (5, None, "en"), (6, "123 !!", "en"), (7, "", "en"), (8, "\u00a0¿?", "es")]
    docs = spark.createDataFrame(texts, "doc_id long, text string, lang_guess string")
    got = {r.doc_id: (r.lang_pred, r.score) for r in language.predict(docs, model, "doc_id").collect()}
    assert [got[i][0] for i in range(1, 9)] == ["en", "de", "fr", "es", "und", "und", "und", "und"] and got[5][1] == 0
    one = language.train(train.filter("lang = 'en'"))
    assert language.predict(docs, one, "doc_id").filter("doc_id = 1").first().lang_pred == "en"
    none = language.train(train.filter("false"))
    assert language.predict(docs, none, "doc_id").filter("lang_pred <> 'und'").count() == 0
    assert language.predict(docs.filter("false"), model, "doc_id").count() == 0


def _plain_features(text):
    """Relative frequencies of hashed byte n-grams, one at a time."""
    folded, out = [], np.zeros(language.DIMENSIONS)
    for c in (text or "").encode():
        c = c + 32 if 65 <= c <= 90 else c
        c = 32 if c < 128 and not 97 <= c <= 122 else c
        if c != 32 or not folded or folded[-1] != 32:
            folded.append(c)
    for k in language.ORDERS:
        for i in range(len(folded) - k + 1):
            key = int.from_bytes(bytes(folded[i : i + k]), "little")
            h = (key ^ (0x9E3779B1 * k & 0xFFFFFFFF)) * 0x85EBCA6B & 0xFFFFFFFF
            out[((h ^ h >> 15) * 0xC2B2AE35 & 0xFFFFFFFF) >> 19] += 1
    return out / max(1, out.sum())


def test_language_features_and_votes_one_at_a_time(spark):
    import pyarrow as pa

    rows = spark.read.parquet(f"{SF}/documents.parquet").select("text", "lang").collect()
    texts = [r.text for r in rows[:120]] + [None, "", "  A ", "é", "12 3", "word " * 40_000]
    got = np.concatenate([x for _, x, _ in language.features(pa.array(texts))])
    want = np.array([_plain_features(t) for t in texts[:-1]])
    assert np.abs(got[:-1] - want).max() < 1e-6 and abs(got[-1].sum() - 1) < 1e-3
    x = want[:120].astype(np.float32)
    model = language.Model(x, [r.lang for r in rows[:120]])
    best, score = model.predict(x)
    for i in range(120):
        m = x[i] @ model.weights + model.bias
        family = max(range(len(model.families)), key=lambda k: (m[k], -k)) if len(model.families) > 1 else 0
        wins = {a: 0.0 for a in model.members[family]}
        for f, a, b, row in model.pairs:
            if f == family:
                wins[a if m[row] >= 0 else b] += 1
        assert wins[best[i]] == max(wins.values()) and 0 <= score[i] <= 1


def test_kept_columns_of_a_results_name_are_replaced(spark):
    docs = frame(spark, [(1, "some words here"), (1, "some words here"), (2, None)]).withColumn("score", F.lit("x")).withColumn("lang_pred", F.lit(7)).withColumn("length", F.lit("y"))
    model = language.train(docs.withColumn("lang", F.lit("en")))
    out = language.predict(docs, model, "doc_id", "score", "lang_pred", "length")
    assert out.columns == ["doc_id", "length", "lang_pred", "score"] and sorted((r.doc_id, r.lang_pred, r.length) for r in out.collect()) == [(1, "en", "y"), (1, "en", "y"), (2, "und", "y")]
    counted = lengths.encoded_lengths(docs, queries.tokenizer(), "length", "doc_id", "score")
    assert counted.columns == ["doc_id", "score", "length"] and sorted(r.length for r in counted.collect()) == [0, 3, 3]
    found = decontaminate.annotate(docs.withColumn("n_hit", F.lit("z")), spark.createDataFrame([("i", "some words")], "item_id string, text string"))
    assert sorted((r.doc_id, r.n_hit) for r in found.collect()) == [(1, 2), (1, 2), (2, 0)]


def test_language_learns_from_other_folds_only(spark):
    import zlib

    rows = queries.op3_language_id(spark, SF).collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in rows)


# ---------------------------------------------------------------- 5
def test_jaccard_brute_force(spark):
    base = [f"w{i}" for i in range(120)]
    near = []
    for i in range(60):  # near copies with 0 to 6 edits, so that links and near misses mix
        w = list(base)
        for j in range(i % 7):
            w[(i * 17 + j * 29) % 120] = f"e{i}_{j}"
        near.append((5000 + i, " ".join(w)))
    docs = documents(spark).select("doc_id", "text").union(frame(spark, [(k + 10_000, t) for k, t in ODD] + near))
    want = brute.classes(pairs(docs))
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.classes(docs).collect()}
    assert got == want
    assert len({c for _, (_, c) in want.items()}) < len(want) - 30


def test_jaccard_edges(spark):
    assert jaccard.classes(frame(spark, [])).count() == 0
    rows = [(1, "a b c d e"), (1, "a b c d e"), (None, "a b c d e"), (2, None), (2, None), (None, None), (3, "z y x w v"), (1, "k l m n o")]
    got = sorted((str(r.doc_id), r.n_shingles, str(r.component_id)) for r in jaccard.classes(frame(spark, rows)).collect())
    assert got.count(("1", 2, "1")) == 3 and ("None", 2, "1") in got and got.count(("2", 0, "2")) == 2 and ("None", 0, "None") in got
    stay = jaccard.one_of_each(frame(spark, rows).withColumn("sig", F.lit("mine")))
    kept = sorted((str(r.doc_id), str(r.text)) for r in stay.collect())
    assert stay.columns == ["doc_id", "text", "sig"]
    assert kept == [("1", "a b c d e"), ("1", "k l m n o"), ("2", "None"), ("2", "None"), ("3", "z y x w v"), ("None", "None")]
    plain = frame(spark).withColumn("component_id", F.lit(0))
    want = brute.classes(ODD)
    assert {r.doc_id for r in jaccard.one_of_each(plain).collect()} == {k for k, (_, c) in want.items() if k == c}


def test_one_of_each_whatever_the_columns_and_the_salt(spark, monkeypatch):
    rows = [(1, "a b c d e f"), (1, "a b c d e f"), (None, "a b c d e f"), (2, None), (3, "z y x w v u"), (1, "k l m n o p")]
    odd = ["_sig", "_gone", "row", "sig", "key", "id", "salt_", "n", "token", "component_id", "root"]
    wide = lambda r: frame(spark, r).select("*", *(F.col("doc_id").alias(c) for c in odd))
    for some in (rows, [r for r in rows if r[0] in (2, 3)] + [(9, "A b c d e f"), (1, rows[0][1])]):
        before = wide(some)
        out = jaccard.one_of_each(before)
        assert out.columns == before.columns and all(r[c] == r.doc_id for r in out.collect() for c in odd)
        plain = sorted(map(str, out.select("doc_id", "text").collect()))
        true, tries = jaccard.signature, []

        def clash(s, salt, true=true):  # under salt 0 all sets share a name
            return (7, true(s, 0)[1]) if salt == 0 else true(s, salt)

        monkeypatch.setattr(jaccard, "signature", clash)
        assert sorted(map(str, jaccard.one_of_each(before).select("doc_id", "text").collect())) == plain, tries
        monkeypatch.setattr(jaccard, "signature", true)


def test_jaccard_with_hot_keys(spark, monkeypatch):
    """All joins dealt out by salts, and a sketch of another size: the same classes."""
    docs = documents(spark).select("doc_id", "text")
    want = sorted(map(tuple, jaccard.classes(docs).collect()))
    monkeypatch.setattr(shared, "HOT_LEAST", 3)
    monkeypatch.setattr(shared, "HOT_SHARE", 0.002)
    monkeypatch.setattr(shared, "BROADCAST_ROWS", 0)
    monkeypatch.setattr(jaccard, "LEAST_BITS", 12)
    assert sorted(map(tuple, jaccard.classes(docs).collect())) == want
    assert brute.classes(pairs(docs)) == {r[0]: (r[3], r[4]) for r in want}


def test_sketch_grows_with_the_input(spark, monkeypatch):
    assert jaccard.sketch_bits(documents(spark)) == jaccard.LEAST_BITS
    monkeypatch.setattr(jaccard, "LEAST_INPUT", 1000)
    assert jaccard.LEAST_BITS < jaccard.sketch_bits(documents(spark)) <= jaccard.MOST_BITS
    assert jaccard.sketch_bits(frame(spark)) in range(jaccard.LEAST_BITS, jaccard.MOST_BITS + 1)


def test_pipeline_drops_copies_of_five_words_and_four_fifths(spark):
    import corpus_pipeline as cp

    words = [f"w{i}" for i in range(200)]
    edited = list(words)
    for i in (20, 60, 110, 160):
        edited[i] = f"e{i}"
    rows = [(1, " ".join(words)), (2, " ".join(words + [f"n{i}" for i in range(44)])), (3, " ".join(edited)), (4, " ".join(words[:150] + [f"z{i}" for i in range(50)]))]
    sets = {(i, k): brute.shingles(t, k) for i, t in rows for k in (4, 5)}
    alike = {(i, k): len(sets[1, k] & sets[i, k]) / len(sets[1, k] | sets[i, k]) for i in (2, 3, 4) for k in (4, 5)}
    assert 0.8 <= alike[2, 5] < 0.85 and alike[2, 4] < 0.85 and 0.8 <= alike[3, 5] and alike[4, 5] < 0.8
    stage = dict(cp.STAGES)["ngram_jaccard"]
    assert sorted(r.doc_id for r in stage(spark, frame(spark, rows), SF).collect()) == [1, 4]
    # By text where a doc_id names several rows.
    twice = frame(spark, rows + [(1, "k l m n o p q")])
    assert sorted((r.doc_id, len(r.text)) for r in stage(spark, twice, SF).collect()) == sorted((k, len(t)) for k, t in [rows[0], rows[3], (1, "k l m n o p q")])


def test_components_of_a_chain(spark):
    edges = spark.range(200).select(F.col("id").alias("u"), (F.col("id") + 1).alias("v")).union(spark.range(500, 501).select("id", F.col("id") + 1))
    got = {r.node: r.root for r in shared.components(edges).collect()}
    assert got == {i: 0 for i in range(201)} | {500: 500, 501: 500}
    assert shared.components(edges.filter("false")).count() == 0


def test_full_bloom_passes_everything(spark):
    keys = spark.range(1000).select(F.xxhash64("id").alias("k"))
    bloom = shared.bloom_of(keys, "k", 1000)
    have = np.array([r.k for r in keys.collect()], np.int64).view(np.uint64)
    other = np.arange(5000, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    assert bloom.has(have).all() and bloom.has(other).mean() < 0.1


def test_lookup_beyond_the_broadcast_bound(spark, monkeypatch):
    big = spark.range(300).select(F.when(F.col("id") % 3 > 0, F.col("id") % 3).alias("k"), "id")
    small = spark.createDataFrame([(None, "n"), (1, "a")], "k long, v string")
    want = sorted(tuple(r) for r in shared.lookup(big, small, "k", 2).select("id", "v").collect())
    assert sorted(tuple(r) for r in shared.lookup(big, small, "k", 10**9).select("id", "v").collect()) == want
    assert want[0] == (0, "n") and want[2] == (2, None)


# ---------------------------------------------------------------- 6
@pytest.mark.parametrize(
    "page,want",
    [
        (None, ""), ("", ""), ("<nav>menu</nav><footer>f</footer>", ""),
        ("<body><nav><a href=x>m</a></nav><article><h1>T &amp; U</h1><p>One<br>two&nbsp; three.<p>Four, five.</article><footer>f</footer></body>", "T & U\nOne two three.\nFour, five."),
        ('<div id="main"><h1>Title</h1><p>Some long text, here it is.</p><div class="comments"><p>Nice, I think so.</p></div></div><aside>x</aside>', "Title\nSome long text, here it is."),
        ('<article><p>Text, of the article.</p><script>var a="</p>";</script><form><p>sign</p></form><div class="ad-banner">Buy, now.</div><p>More.</p></article>', "Text, of the article.\nMore."),
        ('<main><header><h1>Head</h1><p>by me</p></header><p>Body text, long enough.</p><ul><li>a<li>b</ul><table><tr><td>1<td>2</table></main>', "Head\nBody text, long enough.\na\nb\n1\n2"),
        ("a < b and <b>c</b>", "a < b and c"), ('<p>x <a href="a>b">link</a> y</p>', "x link y"), ("<p>unclosed <b>bold<p>next", "unclosed bold\nnext"),
        ('<div class="cookie-notice">We use cookies, ok.</div><div class="content"><p>Real words, in a row.</p><p>And more, of them.</p></div>', "Real words, in a row.\nAnd more, of them."),
        ("<!-- c --><p>&lt;tag&gt; &#65;&#x42;</p>", "<tag> AB"),
    ],
)
def test_main_text(page, want):
    assert html_text.main_text(page) == want


def test_main_text_keeps_all_selected_content():
    long = [f"Sentence number {i} of the first part, with some words, is here." for i in range(17)]
    short = [f"Sentence number {i} of the second part, with some words, is here." for i in range(3)]
    p = lambda rows: "".join(f"<p>{x}</p>" for x in rows)
    page = f'<body><nav>menu</nav><div id="content"><section>{p(long)}</section><section>{p(short)}</section></div><footer>f</footer></body>'
    assert html_text.main_text(page) == "\n".join(long + short)
    # A list with most of the text does not push out the paragraphs around it.
    items = "".join(f"<li>{x}</li>" for x in long)
    page = f"<body><nav>menu</nav><div><h1>Head</h1><p>Before it, so.</p><ul>{items}</ul><p>After it.</p></div></body>"
    assert html_text.main_text(page) == "\n".join(["Head", "Before it, so.", *long, "After it."])
    rows = "".join(f"<tr><td>{x}</td></tr>" for x in long)
    page = f"<body><div><p>Before it, so.</p><table><tbody>{rows}</tbody></table><p>After it.</p></div></body>"
    assert html_text.main_text(page) == "\n".join(["Before it, so.", *long, "After it."])


def _articles(pages):
    """{page_id: the blocks inside the page's article}, by patterns that know the tables' pages."""
    import html
    import re

    out = {}
    for r in pages:
        inner = re.search(r"(?s)<article>(.*?)</article>", r.html)[1]
        blocks = [" ".join(html.unescape(re.sub("</?b>", "", re.sub("<br>", " ", x))).split()) for x in re.split("</?(?:p|h1)>", inner)]
        out[r.page_id] = "\n".join(b for b in blocks if b)
    return out


def test_html_names_remove_no_words_of_the_article():
    long = ["A first sentence of some length, which goes on, and on.", "Another one follows it; it is as long as the first was.", "A third, so that there is a text."]
    plain = "".join(f"<p>{x}</p>" for x in long)
    for odd, want in [
        ('<p>He left a <span class="comment">short remark</span> on the wall.</p>', "He left a short remark on the wall."),
        ('<p>In the <span title="a hidden gem">valley of roses</span> we met.</p>', "In the valley of roses we met."),
        ('<p title="the hidden valley">Nobody knows the hidden valley, they say.</p>', "Nobody knows the hidden valley, they say."),
        ('<p class="share price">The price of a share rose, then fell, then rose again that day.</p>', "The price of a share rose, then fell, then rose again that day."),
        ('<blockquote class="related-work">Work that is related, said the author, is never quite the same.</blockquote>', "Work that is related, said the author, is never quite the same."),
        ('<p id="social">Social matters, they wrote, are matters of all of us, always.</p>', "Social matters, they wrote, are matters of all of us, always."),
        ('<p data-hidden="x" class="lead">It begins here, with a line.</p>', "It begins here, with a line."),
        ('<p>Seen<span hidden> and unseen</span>, <b style="display: none">never </b>told.</p>', "Seen, told."),
    ]:
        page = f"<html><body><nav><a href=/>Home</a></nav><article><h1>Head</h1>{plain}{odd}</article><div class=ad>Buy now.</div></body></html>"
        assert html_text.main_text(page) == "\n".join(["Head", *long, want])
    inside = '<div class="ad">Buy this, and buy that, as long as it lasts, dear reader.</div><div class="comments"><p>I liked it, said a reader of the page, very much.</p></div>'
    assert html_text.main_text(f"<body><article><h1>Head</h1>{plain}{inside}</article></body>") == "\n".join(["Head", *long])


def test_html_on_the_tables_and_edges(spark):
    pages = spark.read.parquet(f"{SF}/pages.parquet")
    assert {r.page_id: r.text for r in html_text.extract(pages).collect()} == _articles(pages.collect())
    odd = spark.createDataFrame([(1, None, "x"), (1, "<p>" * 3000 + "deep" + "</p>" * 3000, "y"), (None, "<" * 5000, "z")], "page_id long, html string, text string")
    out = html_text.extract(odd).collect()
    assert len(out) == 3 and out[0].text == "" and out[1].text == "deep" and html_text.extract(odd.filter("false")).count() == 0
    twice = html_text.extract(odd.union(odd).withColumn("path", F.lit(7)), to="main").collect()
    assert len(twice) == 6 and twice[1].main == twice[4].main and twice[0].text == "x" and twice[0].path == 7


def test_html_is_decided_by_the_ratios(spark, monkeypatch):
    import random

    pages = spark.read.parquet(f"{SF.replace('0.001', '0.01')}/pages.parquet").collect()
    want = _articles(pages)
    plain = lambda h: h.replace("<article>", "<div>").replace("</article>", "</div>")
    bare = lambda h: plain(h).replace('class="ad"', 'class="x"')
    same_ = lambda f: sum(html_text.main_text(f(r.html)) == want[r.page_id] for r in pages) / len(pages)
    assert same_(lambda h: h) == 1 and same_(plain) == 1 and same_(bare) > 0.8
    true, rng = html_text.path_ratios, random.Random(3)
    for fake in (
        lambda b: {p: (50.0, 1.0, x) for p, (_, _, x) in true(b).items()},
        lambda b: {p: (-n, q, x) for p, (n, q, x) in true(b).items()},
        lambda b: {p: (300 * rng.random(), rng.random(), x) for p, (_, _, x) in true(b).items()},
    ):
        monkeypatch.setattr(html_text, "path_ratios", fake)
        assert same_(bare) < 0.3


def test_main_text_without_telling_names():
    prose = [f"This is sentence {i} of the text, which goes on for a while; it has commas, and ends." for i in range(6)]
    p = "".join(f"<p>{x}</p>" for x in prose)
    links = "".join(f"<li><a href=/{i}>Item {i}</a></li>" for i in range(12))
    page = f"<div class=a><ul>{links}</ul></div><div class=b><div class=c><h2>Head</h2>{p}</div><div class=d><p>Buy it.</p></div></div><div class=e>All rights.</div>"
    assert html_text.main_text(page) == "\n".join(["Head", *prose])
    # A mark on an element around everything decides nothing, one inside does.
    inner = f"<article><h1>Head</h1>{p}<div class='related-box'><p>See this.</p></div></article>"
    for wrap in ("<div id=page class='site no-sidebar'>", "<div class='header-fixed'><div class=widget>", "<body class='menu nav'>"):
        assert html_text.main_text(wrap + inner) == "\n".join(["Head", *prose])
    rows = "".join(f"<tr><td>{x}<td>{i}" for i, x in enumerate(prose))
    assert html_text.main_text(f"<div><table>{rows}</table></div>") == "\n".join(v for i, x in enumerate(prose) for v in (x, str(i)))


def test_main_text_takes_time_in_proportion():
    import time

    pages = [
        "<div>x" * 100_000, "<b>x" * 100_000 + "</i>" * 100_000, "<i>" * 50_000 + "<article>" + "</i>" * 100_000, "<a " * 300_000, "<a '>" * 100_001,
        '<a ">' * 100_001, "<!" * 300_000, "<p>" * 100_000, "<table><tr><td>" * 30_000, "<b>" * 50_000 + "<div></div>" * 50_000, "<x " + "a" * 1_000_000 + ">t",
        "<ul>" * 50_000 + "<li>" * 50_000, "<p>" + "word " * 1_000_000,
    ]
    for page in pages:
        began = time.process_time()
        html_text.main_text(page)
        assert time.process_time() - began < 4, page[:20]
    assert html_text.main_text("<p>&#" + "9" * 9000 + "; ok") == "\ufffd ok"


# ---------------------------------------------------------------- 7
def test_url_rules_and_verdicts(spark):
    rows = [
        (1, "https://A.Example.NET/en/x?q=1"), (2, "http://example.net/fr/x"), (3, "https://m.example.com/de/1#t"), (4, "http://x.org/fr/"), (5, "http://notexample.net.com/en/"),
        (6, None), (7, "nothing"), (8, "ftp://net/a"), (9, "https://best-casino-bonus.example.com/en/1"), (10, "https://library.example.com/en/7"), (11, "https://myexample.com/de/x"), (12, "://?"),
        (13, "a://b://c/d"), (14, "https://example.com/de"), (15, "http://h\nost/p\nath?x"),
    ]
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in urls.judge(spark.createDataFrame(rows, "page_id long, url string")).collect()}
    assert got[1] == ("a.example.net", "/en/x", "example.net/en/", "allow") and got[2] == ("example.net", "/fr/x", "net/", "block")
    assert got[3] == ("m.example.com", "/de/1", "example.com/de/", "block") and got[4] == ("x.org", "/fr/", "org/fr/", "allow")
    assert got[5][2] is None and got[6] == ("", "", None, "allow") and got[7] == ("", "", None, "allow") and got[8][2:] == ("net/", "block")
    assert got[9][2:] == (None, "block") and got[10][2:] == (None, "allow") and got[11][2] is None and got[12][:2] == ("", "")
    assert got[13][:2] == ("b:", "//c/d") and got[14][2] is None and got[15][:2] == ("h\nost", "/p\nath")
    clash = spark.createDataFrame([(1, "http://garden.org/c", 9, "h", "v", 0.5)], "page_id long, url string, _rest int, host string, verdict string, p double")
    row = urls.judge(clash).first()
    assert urls.judge(clash.filter("false")).count() == 0 and row[:4] == (1, "http://garden.org/c", 9, 0.5) and (row.host, row.path, row.verdict) == ("garden.org", "/c", "allow")
    long = urls.judge(spark.createDataFrame([("http://x.org/fr/" + "a/" * 200_000,)] * 2, "url string")).collect()
    assert len(long) == 2 and len(long[0].path) == 400_004 and {r.rule for r in long} == {"org/fr/"}


def test_url_twin_of_host_path_and_rule(spark):
    from tests.oracle import connect, rows_of

    rest = "CASE WHEN contains(url, '://') THEN substr(url, strpos(url, '://') + 3) ELSE '' END"
    fits = lambda r: f"(host = '{r.partition('/')[0]}' OR ends_with(host, '.{r.partition('/')[0]}')) AND starts_with(path, '/{r.partition('/')[2]}')"
    cases = " ".join(f"WHEN {fits(r)} THEN '{r}'" for _, r in sorted(urls.RULES, key=lambda x: -len(x[1])))
    sql = rf"""WITH s AS (SELECT page_id, {rest} AS rest FROM pages),
h AS (SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM s)
SELECT page_id, host, path, CASE {cases} END AS rule FROM h"""
    sf = SF.replace("0.001", "0.01")
    got = queries.op7_url_filters(spark, sf).select("page_id", "host", "path", "rule")
    want = connect(sf).sql(sql)
    assert rows_of(got.columns, [tuple(r) for r in got.collect()]) == rows_of(want.columns, want.fetchall())
    says = {r: v for v, r in urls.RULES}
    assert all(r.verdict == says[r.rule] for r in queries.op7_url_filters(spark, sf).filter("rule IS NOT NULL").collect())


def test_url_classifier_on_unseen_hosts():
    """Hosts that the table does not have: its words in new company, and made-up names."""
    rng = np.random.default_rng(1)
    known = {h for h, _, _ in urls.labelled()}
    new = "garage studio land house network market store point team city".split()
    bad = [f"{w}-{n}" for w in urls.BLOCKED for n in rng.choice(new, 2)] + [f"{a}-{b}" for a, b in zip(urls.BLOCKED, rng.permutation(urls.BLOCKED))]
    good = [f"{w}-{n}" for w in urls.ALLOWED for n in rng.choice(new, 1)] + [f"{n}{w}" for w in urls.ALLOWED for n in rng.choice(new, 1)]
    good += ["".join(rng.choice(list("bcdfglmnprst")) + rng.choice(list("aeiou")) for _ in range(4)) for _ in range(300)]
    model = urls.train()
    blocked = lambda names: np.mean([urls.probability(model, f"{n}.example.com", "/en/12") >= 0.5 for n in names if f"{n}.example.com" not in known])
    assert blocked(bad) > 0.7 and blocked(good) < 0.02
    assert np.mean([(urls.probability(model, h, p) >= 0.5) == (y > 0) for h, p, y in urls.labelled()]) > 0.9


# ---------------------------------------------------------------- 8
def test_quality_brute_force(spark):
    docs = frame(spark, ODD + [(100, "a b c " * 30), (101, "x\nx\n \nx\ny #*%"), (102, " lead and trail \r\n\x0b z")]).withColumn("source", F.lit(None).cast("string"))
    for r in quality.judge(docs).collect():
        text = dict(ODD + [(100, "a b c " * 30), (101, "x\nx\n \nx\ny #*%"), (102, " lead and trail \r\n\x0b z")])[r.doc_id]
        want = brute.measures(text)
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want, r.doc_id
        assert r.base_failed == (want[0] < 50 or 100 * want[4] > 50 * want[0])


def test_repeated_positions_under_equal_high_bits(spark):
    arrays = [[16, 17, 16], [16, 17, 18, 16, 17], [-1, 5, -1, -2, 5, 5], [1 << 40, (1 << 40) + 1, 1 << 40, 9], [], [3], [7] * 9, list(range(64, 96)) + [70]]
    docs = spark.createDataFrame([(i, a) for i, a in enumerate(arrays)], "i int, h array<long>")
    got = {r.i: r.p for r in docs.select("i", quality.repeated_positions(F.col("h")).alias("p")).collect()}
    assert got == {i: [k for k, v in enumerate(a) if a.count(v) > 1] for i, a in enumerate(arrays)}


def test_quality_of_very_long_texts(spark):
    import random

    rng = random.Random(2)
    text = " ".join(rng.choice("abcdefgh") + str(rng.randrange(400)) for _ in range(150_000))
    r = quality.judge(frame(spark, [(1, text)]).withColumn("source", F.lit("s"))).first()
    assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == brute.measures(text)


def test_host_verdicts(spark):
    good = " ".join(f"word{i}" for i in range(60))
    bad = " ".join(f"w{i} ##" for i in range(60))
    rows = [(i, "good", good) for i in range(40)] + [(100 + i, "bad", "junk") for i in range(60)] + [(200, "bad", good)] + [(300, "new", "junk"), (301, "new", good)]
    rows += [(400 + i, "mixed", bad if i % 4 else good) for i in range(40)] + [(500, None, good)]
    docs = spark.createDataFrame(rows, "doc_id long, source string, text string")
    got = {r.doc_id: r for r in quality.judge(docs).collect()}
    assert all(got[i].kept for i in range(40)) and got[500].kept and got[301].kept
    assert got[200].host_verdict == "rejected" and not got[200].kept
    assert got[400].kept and not got[401].kept and got[401].host_verdict == "watched" and not got[401].base_failed
    kept = quality.keep_good(docs.withColumn("failed", F.lit(1)).withColumn("n_words", F.lit("x")))
    assert kept.columns == ["doc_id", "source", "text", "failed", "n_words"]
    assert sorted(r.doc_id for r in kept.collect()) == sorted(k for k, r in got.items() if r.kept)
    assert quality.judge(docs.filter("false")).count() == 0 and quality.keep_good(docs.filter("false")).count() == 0


def test_hosts_vouch_for_documents_that_fail_a_soft_rule(spark):
    """By a plain version of the prior and the posterior: evidence is needed, and the prior decides how much."""
    good = " ".join(f"word{i}" for i in range(60))
    soft = " ".join(f"w{i} ##" for i in range(60))
    hosts = {"clean": (200, 4), "like the rest": (100, 25), "worse": (100, 40), "one soft": (0, 1), "one good": (1, 0), None: (30, 1)}
    rows = [(h, good) for h, (g, _) in hosts.items() for _ in range(g)] + [(h, soft) for h, (_, b) in hosts.items() for _ in range(b)]
    docs = spark.createDataFrame([(i, h, x) for i, (h, x) in enumerate(rows)], "doc_id long, source string, text string")
    tn, tk, th = len(rows), sum(b for _, b in hosts.values()), len(hosts)
    p, sizes = tk / tn, {h: g + b for h, (g, b) in hosts.items()}
    ss = sum(sizes[h] * (b / sizes[h] - p) ** 2 for h, (_, b) in hosts.items())
    rho = (ss - (th - 1) * p * (1 - p)) / (p * (1 - p) * (tn - sum(n * n for n in sizes.values()) / tn - th + 1))
    s = 1 / min(0.5, max(0.001, rho)) - 1
    want = {}
    for h, (_, b) in hosts.items():
        m = (b + p * s) / (sizes[h] + s)
        want[h] = (m - p) / (m * (1 - m) / (sizes[h] + s + 1)) ** 0.5
    got = quality.judge(docs).collect()
    for r in got:
        assert r.host_z == pytest.approx(want[r.source]) and r.host_verdict == ("trusted" if want[r.source] <= quality.DOUBT_Z else "watched")
        assert not r.base_failed and r.kept == (not r.failed or r.host_verdict == "trusted")
    assert {r.source for r in got if r.failed and r.kept} == {"clean", None}
    odd = docs.toDF("a.b", "c d", "e.f")
    again = quality.judge(odd, "a.b", "c d", "e.f")
    assert {"a.b", "c d"} <= set(again.columns) and sorted(r["a.b"] for r in again.filter("kept").collect()) == sorted(r.doc_id for r in got if r.kept)


def test_hosts_change_verdicts_of_the_given_documents(spark):
    docs = spark.read.parquet(f"{SF.rsplit('/', 1)[0]}/sf0.01/documents.parquet").select("doc_id", "source", "text")
    got = {r.doc_id: r for r in quality.judge(docs).collect()}
    soft = [r for r in got.values() if r.failed and not r.base_failed]
    assert {r.kept for r in soft} == {True, False} and all(r.kept for r in got.values() if not r.failed)
    moved = docs.withColumn("source", F.concat(F.lit("src"), (F.crc32(F.col("doc_id").cast("string")) % 20).cast("string")))
    assert any(r.kept != got[r.doc_id].kept for r in quality.judge(moved).collect())


def test_native_plans(spark):
    for name in ("op8_quality_rules", "op10_mix_sources"):
        plan = queries.queries()[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
        assert "Python" not in plan and "Arrow" not in plan


# ---------------------------------------------------------------- 9
def test_cut_brute_force(spark):
    shared_ = " ".join(f"passage{i}" for i in range(60))
    rows = ODD + [(50 + i, f"start {i} " * (i + 1) + shared_ + f" end {i}" * 9) for i in range(8)] + [(70, "é" * 150 + "tail"), (71, "head" + "é" * 150)]
    docs = documents(spark).select((F.col("doc_id") + 1000).alias("doc_id"), "text").union(frame(spark, rows))
    want = brute.cut(pairs(docs))
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, hashlib.sha256(r.kept).hexdigest()) for r in phrases.remove(docs).collect()}
    assert got == want
    hot = phrases.repeats(phrases.keyed(docs), hot_phrases=2).collect()
    assert sorted(hot) == sorted(phrases.repeats(phrases.keyed(docs)).collect())


@pytest.mark.parametrize("n,depth", [(1, 1), (50, 5), (300, 7), (3000, 200), (3000, 3), (700, 200), (4000, 11)])
def test_suffix_array(n, depth, monkeypatch):
    from folioforge.llm import bytescan

    rng = np.random.default_rng(n + depth)
    data = rng.integers(97, 99, n).astype(np.uint8)
    data[n // 2 : n // 2 + n // 3] = data[: n // 3]
    starts = np.arange(n - depth + 1)[rng.random(n - depth + 1) < 0.9]
    raw = [bytes(data[s : s + depth]) for s in starts]
    names = {x: i for i, x in enumerate(sorted(set(raw)))}
    for place in (21, 3):  # packed integers, and the way without
        monkeypatch.setattr(bytescan, "_PLACE", place)
        order, rank = bytescan.suffix_array(data, starts, depth)
        assert order.tolist() == sorted(range(len(raw)), key=lambda i: (raw[i], i))
        assert rank.tolist() == [names[raw[i]] for i in order]


def test_cut_of_long_texts_and_many_arrays(spark, monkeypatch):
    import random

    rng = random.Random(4)
    base = "".join(rng.choice("abcdefghij ") for _ in range(30_000))
    rows = [(1, base + "x" * 50_000)]
    for i in range(2, 12):  # near copies: matches that begin and end inside phrases
        t = list(base[500 * i : 500 * i + 9000])
        for j in range(i % 4):
            t[(i * 2711 + j * 3331) % 9000] = "Z"
        rows.append((i, "".join(t)))
    monkeypatch.setattr(phrases, "FLUSH_BYTES", 2000)
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, hashlib.sha256(r.kept).hexdigest()) for r in phrases.remove(frame(spark, rows)).collect()}
    assert got == brute.cut(rows)


def test_cut_edges(spark):
    assert phrases.remove(frame(spark, [])).count() == 0
    long = "".join(chr(97 + (i * i + i // 7) % 26) for i in range(500))
    rows = frame(spark, [(1, long), (1, long), (None, long[:250]), (None, None), (2, long[:199])]).withColumn("lo", F.lit(1)).withColumn("h", F.lit("x"))
    got = sorted((str(r.doc_id), r.n_bytes, r.n_removed, r.n_spans) for r in phrases.remove(rows).collect())
    assert got == [("1", 500, 500, 1), ("1", 500, 500, 1), ("2", 199, 0, 0), ("None", 0, 0, 0), ("None", 250, 250, 1)]


# ---------------------------------------------------------------- 10
def test_mix_brute_force(spark):
    docs = documents(spark)
    got = mixing.plan(docs, "doc_id", "source").collect()
    sizes = {}
    for r in docs.collect():
        sizes[r.source] = sizes.get(r.source, 0) + len(brute.words(r.text))
    want = brute.targets(sizes)
    for s, t in want.items():
        mine = [r for r in got if r.source == s]
        assert all(abs(r.target - t) < 1e-6 * t and r.source_size == sizes[s] and r.taken <= 3 * r.size for r in mine)
        assert abs(sum(r.taken for r in mine) - t) <= max(r.size for r in mine) / 2 + 1
    again = {r.doc_id: r.taken for r in mixing.plan(docs.repartition(7), "doc_id").collect()}
    assert again == {r.doc_id: r.taken for r in got}


def test_mix_takes_the_same_rows_however_they_are_dealt(spark):
    rows = [(i // 100, "one two three", f"s{i % 2}", i) for i in range(400)] + [(9, "word " * 50, "s9", -1)] * 8
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, more int")
    one, four = (sorted(map(tuple, mixing.apply_mix(docs.repartition(n, by)).collect())) for n, by in ((1, "more"), (4, "text"), ))
    assert one == four and len(one) > 0
    assert one == sorted(map(tuple, mixing.apply_mix(docs.orderBy(F.desc("more"))).collect()))


def test_mix_refines_and_caps(spark, monkeypatch):
    rows = [(i, "big" if i % 10 else ["a", "b", None][i // 10 % 3], " ".join(["w"] * (1 + i % 5))) for i in range(900)]
    docs = spark.createDataFrame(rows, "doc_id long, source string, text string")
    whole = sorted((r.doc_id, r.taken) for r in mixing.plan(docs, "doc_id").collect())
    monkeypatch.setattr(mixing, "STEP_BITS", 4)
    assert sorted((r.doc_id, r.taken) for r in mixing.plan(docs, "doc_id").collect()) == whole
    sizes = {}
    for _, s, t in rows:
        sizes[s] = sizes.get(s, 0) + len(t.split())
    want = brute.targets(sizes)
    assert want["a"] == 3 * sizes["a"]
    taken = {}
    for k, n in whole:
        taken[rows[k][1]] = taken.get(rows[k][1], 0) + n
    assert all(abs(taken[s] - want[s]) <= 3 for s in sizes)
    out = mixing.apply_mix(docs.withColumn("size", F.lit("x")).withColumn("h", F.lit(0)))
    assert out.columns == ["doc_id", "source", "text", "size", "h"] and out.count() == sum(n // len(rows[k][2].split()) for k, n in whole)


def test_mix_edges(spark):
    none = spark.createDataFrame([], "doc_id long, source string, text string")
    assert mixing.plan(none, "doc_id").count() == 0
    rows = [(1, "a", None), (2, None, ""), (None, "b", "x y"), (None, "b", "x y"), (3, None, "one two three"), (3, None, "one two three")]
    got = mixing.plan(spark.createDataFrame(rows, "doc_id long, source string, text string"), "doc_id", "text").collect()
    assert len(got) == 6 and sum(r.size for r in got) == 10 and all(r.taken <= 3 * r.size for r in got)

def test_mix_takes_as_many_equal_rows_as_come_nearest(spark):
    rows = [(7, "a", "one two three four five six seven eight nine ten")] * 200 + [(i, "b", "w " * 20) for i in range(100)]
    docs = spark.createDataFrame(rows, "doc_id long, source string, text string")
    got = mixing.plan(docs.repartition(5), "doc_id", "source").collect()
    target = {r.source: r.target for r in got}
    assert 2000 < target["a"] < 3000 and len({r.taken for r in got if r.source == "a"}) == 2
    for s, size in (("a", 10), ("b", 20)):
        assert abs(sum(r.taken for r in got if r.source == s) - target[s]) <= size / 2
    again = sorted((r.doc_id, r.taken) for r in mixing.plan(docs.repartition(2), "doc_id").collect())
    assert again == sorted((r.doc_id, r.taken) for r in got)
    from tests.oracle import connect, rows_of

    con = connect()
    con.register("rows_", docs.toPandas())
    con.sql("CREATE OR REPLACE VIEW documents AS SELECT * FROM rows_")
    want = con.sql(oracles.OP10)
    mine = mixing.plan(docs, "doc_id").select("doc_id", "size", "source_size", "target", "taken")
    assert rows_of(mine.columns, [tuple(r) for r in mine.collect()]) == rows_of(want.columns, want.fetchall())
    with pytest.raises(ValueError):
        mixing.plan(docs.withColumn("size", F.lit(1)), "size")


# ---------------------------------------------------------------- pipeline
def test_pipeline_brute_force(spark):
    import corpus_pipeline as cp

    sf, kept = SF, {}
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    cols = docs.columns
    for name, stage in cp.STAGES:
        before = docs
        docs = shared.materialise(stage(spark, docs, sf), name)
        kept[name] = docs.collect()
        if name != "token_output":
            assert docs.columns == cols
        if name == "quality_rules":
            judged = {r.doc_id: r.kept for r in quality.judge(before).collect()}
            assert sorted(r.doc_id for r in kept[name]) == sorted(k for k, v in judged.items() if v)
        if name == "ngram_jaccard":
            want = brute.classes(pairs(before))
            assert sorted(r.doc_id for r in kept[name]) == sorted(k for k, (_, c) in want.items() if k == c)
        if name == "decontamination":
            bench = [tuple(r) for r in spark.read.parquet(f"{sf}/benchmark.parquet").select("item_id", "text").collect()]
            want = brute.decontaminate(pairs(before), bench)
            assert sorted(r.doc_id for r in kept[name]) == sorted(k for k, (_, hit, _) in want.items() if not hit)
        if name == "mix_sources":
            plan = {r.doc_id: r.times for r in mixing.plan(before, "doc_id").collect()}
            assert sorted(r.doc_id for r in kept[name]) == sorted(k for k, n in plan.items() for _ in range(n))
    tok, at = _tokenizer(), 0
    texts = sorted((r.doc_id, r.text) for r in kept["mix_sources"])
    got = sorted((r.start, r.doc_id, r.n_tokens, r.ids_crc32) for r in kept["token_output"])
    for (start, key, n, crc), (k, text) in zip(got, texts, strict=True):
        ids = tok.encode(text, add_special_tokens=False).ids + [1]
        assert (start, key, n, crc) == (at, k, len(ids), brute.crc(ids))
        at += n
    assert cp.run(spark, sf).count() == len(got)
