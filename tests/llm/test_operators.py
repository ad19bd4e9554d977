"""Each query against brute force, on odd rows and on a small whole table."""

import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from helpers import filler, jaccard, sha, shingles, words
from lucera.llm import bpe, jaccard_join, queries, token_files, warc_zip
from lucera.llm.common import Work, Words, text_buffers

TABLES = ["odd", "small"]


@pytest.fixture(params=TABLES)
def data(request):
    return request.getfixturevalue(request.param)


def docs_of(spark, path):
    return [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{path}/documents.parquet").select("doc_id", "text").collect()]


def in_order(rows, spark):
    """(doc_id, text) in the order of ids, equal ids by Spark's hash of text."""
    from pyspark.sql import functions as F

    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("text", F.coalesce("text", F.lit("")))
    return [tuple(r) for r in df.orderBy("doc_id", F.xxhash64("text")).collect()]


def run(spark, name, path):
    return queries.QUERIES[name](spark, path).collect()


@pytest.mark.parametrize("name", list(queries.QUERIES))
def test_empty_tables(spark, empty, name):
    assert run(spark, name, empty) == []


def test_pipeline_on_odd_and_empty(spark, odd, empty):
    import corpus_pipeline

    assert corpus_pipeline.run(spark, empty).count() == 0
    assert corpus_pipeline.run(spark, odd).count() > 0


@pytest.mark.parametrize("name", list(queries.ORACLE_SQL))
def test_sql(spark, data, name):
    con = duckdb.connect()
    for t in ("documents", "pages"):
        path = f"{data}/{t}.parquet" + ("/*.parquet" if "testdata" not in data else "")
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{path}')")
    df = queries.QUERIES[name](spark, data)
    cols = sorted(df.columns)
    theirs = con.sql(queries.ORACLE_SQL[name])
    assert sorted(theirs.columns) == cols
    show = lambda rows: sorted(str([f"{v:.9g}" if isinstance(v, float) else v for v in r]) for r in rows)
    assert show(df.select(cols).collect()) == show(theirs.select(", ".join(cols)).fetchall())


def test_words_and_grams_by_brute_force(spark, data):
    import pyarrow as pa

    texts = [t for _, t in docs_of(spark, data)]
    raw, offs = text_buffers(pa.array(texts, pa.string()))
    w = Words(raw, offs)
    assert w.counts().tolist() == [len(words(t)) for t in texts]
    flat = [x for t in texts for x in words(t)]
    assert [raw[a:b].tobytes().decode() for a, b in zip(w.start, w.end)] == flat
    assert len(set(w.hashes.tolist())) == len(set(flat))
    g, at = w.grams(5)
    for i, t in enumerate(texts):
        assert len(set(g[at[i] : at[i + 1]].tolist())) == len(shingles(t))


def test_classifier(spark):
    from pyspark.sql import functions as F

    rows = queries.QUERIES["op1_quality_classifier"](spark, "/root/testdata/sf0.1").collect()
    labels = dict(duckdb.sql("SELECT doc_id, quality FROM read_parquet('/root/testdata/sf0.1/labels.parquet')").fetchall())
    held = [(r["score"], labels[r["doc_id"]]) for r in rows if r["held_out"] and r["doc_id"] in labels]
    assert all((zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) == r["held_out"] for r in rows)
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3) for r in rows)
    good, bad = [s for s, y in held if y], [s for s, y in held if not y]
    auc = np.mean([(g > b) + 0.5 * (g == b) for g in good for b in bad])
    print("AUC", auc, "accuracy", np.mean([(s >= 0.3) == y for s, y in held]), len(held))
    assert auc > 0.999 and np.mean([(s >= 0.3) == y for s, y in held]) > 0.99


def test_word_vectors_and_pools_by_brute_force(monkeypatch):
    import re

    import pyarrow as pa
    from lucera.llm import quality_classifier as q

    monkeypatch.setattr(q, "SLICE", 7)
    texts = ["the cat!! sat on THE mat 12", "", "a|b c&&&", None, "the cat the cat the cat on on on", "x"]
    t = q.Texts(pa.array(texts, pa.string()))
    cut = [re.findall(r"[A-Za-z\x80-\U0010ffff]+|[0-9]+|[^A-Za-z0-9\s]+", x or "") for x in texts]
    assert t.n.tolist() == [len(x) for x in cut]
    flat = [w for x in cut for w in x]
    name = dict(zip(flat, t.word.tolist(), strict=True))
    assert [name[w] for w in flat] == t.word.tolist() and len(set(name.values())) == len(name)
    place, sign = q._random_index()
    index = np.zeros((q.BUCKETS, q.DIM))
    for b in name.values():
        for k in range(q.NONZERO):
            index[b, place[b, k]] += sign[b, k]
    expect, share = np.zeros((q.BUCKETS, q.DIM)), Counter(flat)
    for x in cut:
        for i, w in enumerate(x):
            for j in range(max(0, i - q.REACH), min(len(x), i + q.REACH + 1)):
                if i != j:
                    expect[name[w]] += index[name[x[j]]] * q.RARE / (q.RARE + share[x[j]] / len(flat))
    expect /= np.maximum(np.linalg.norm(expect, axis=1, keepdims=True), 1e-9)
    vectors = q.word_vectors(lambda: [t])
    assert np.allclose(vectors, expect, atol=1e-5)
    got = t.pooled(vectors)
    for i, x in enumerate(cut):
        v = np.array([vectors[name[w]] for w in x]).reshape(-1, q.DIM)
        mean = v.mean(0) if len(v) else np.zeros(q.DIM)
        pair = (v[1:] * v[:-1]).mean(0) if len(v) > 1 else np.zeros(q.DIM)
        assert np.allclose(got[i], np.concatenate([mean, pair]), atol=1e-5)


def test_batches_are_cut_by_bytes(monkeypatch):
    import pyarrow as pa
    from lucera.llm import common

    monkeypatch.setattr(common, "BATCH_BYTES", 10)
    texts = ["abc", None, "x" * 50, "", "abcdefgh", "ab", "abc", "y" * 11]
    batch = pa.RecordBatch.from_arrays([pa.array(range(8)), pa.array(texts, pa.string())], ["k", "text"])
    parts = [p.column("text").to_pylist() for p in common.slices([batch, batch.slice(2, 0)])]
    assert sum(parts, []) == texts and all(sum(len(t or "") for t in p) <= 10 or len([t for t in p if t]) == 1 for p in parts)


def test_classifier_on_odd(spark, odd):
    rows = run(spark, "op1_quality_classifier", odd)
    assert len(rows) == 18 and all(0 <= r["score"] <= 1 for r in rows)


def test_fingerprints(spark, data):
    rows = run(spark, "op3_document_fingerprints", data)
    docs = in_order(docs_of(spark, data), spark)
    expect = Counter()
    errors, same = [], {}
    sets = {}
    for i, (d, t) in enumerate(docs):
        nxt = docs[(i + 1) % len(docs)][1]
        h = len(t) // 2
        e = t[: len(t) - h] + nxt[:h]
        expect[(d, len(t), sha(e))] += 1
        sets[(d, sha(e))] = (t, e, nxt)
    assert Counter((r["doc_id"], r["n_chars"], r["edited_sha256"]) for r in rows) == expect
    for r in rows:
        t, e, nxt = sets[(r["doc_id"], r["edited_sha256"])]
        for text, fp in ((t, r["fingerprint"]), (e, r["edited_fingerprint"])):
            assert same.setdefault(text, fp) == fp
        if t == e:
            assert r["near_edited"] == 1.0
        errors.append(abs(r["near_edited"] - (jaccard(shingles(t), shingles(e)) if words(t) or words(e) else 1.0)))
        assert 0 <= r["near_next"] <= 1
        if len(shingles(t) | shingles(nxt)) > 20:
            errors.append(abs(r["near_next"] - jaccard(shingles(t), shingles(nxt))))
    assert np.mean(errors) < 0.03, np.mean(errors)


def test_mixing_meets_targets(spark, data):
    rows = run(spark, "op4_mixing", data)
    taken, target = Counter(), {}
    for r in rows:
        assert 0 <= r["taken"] <= 3 * r["size"]
        taken[r["source"]] += r["taken"]
        target[r["source"]] = r["target"]
    assert all(abs(taken[s] - target[s]) <= 1 for s in target)


def test_html_against_markup(spark):
    import re
    from html import unescape

    rows = run(spark, "op5_html_extraction", "/root/testdata/sf0.01")
    pages = dict(duckdb.sql("SELECT page_id, html FROM read_parquet('/root/testdata/sf0.01/pages.parquet')").fetchall())
    for r in rows:
        body = re.search(r"<article>(.*?)</article>", pages[r["page_id"]] or "", re.S)
        parts = [" ".join(unescape(re.sub(r"<[^>]+>", "", p)).split()) for p in re.split(r"</?(?:p|h1|article)>", body.group(1).replace("<br>", " "))] if body else []
        assert r["text"] == "\n\n".join(p for p in parts if p)
        assert r["n_chars"] == len(r["text"])


def test_html_odd(spark, odd):
    got = {r["page_id"]: r["text"] for r in run(spark, "op5_html_extraction", odd)}
    assert got[1] == "\n\n".join(["some words of the main text here"] * 3)
    assert got[2] == got[3] == "" and got[4] == "no markup at all & done" and got[5] == "unclosed text" and "deep" in got[11]


def test_token_files(spark, data):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    start, expect = 0, []
    for d, text in in_order(docs_of(spark, data), spark):
        ids = [*t.encode(text, add_special_tokens=False).ids, 0]
        expect.append((d, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    assert sorted(tuple(r) for r in run(spark, "op6_token_files", data)) == sorted(expect)


def test_token_pieces_of_odd_white_space():
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    t, e = Tokenizer.from_file(path), token_files.Encoder(path)
    for text in ("a <|endoftext|> b", "<|endoftext|>", " <|endoftext|><|endoftext|>x\u3000y <|endoftext|", "é\u3000<|endoftext|>\n"):
        ids = t.encode(text, add_special_tokens=False).ids
        assert e.encode(text).tolist() == ids
        assert e.encode_batch(pa.array(["x y", text, "z"], pa.large_string()))[0].tolist() == [*t.encode("x y").ids, *ids, *t.encode("z").ids]
    assert 50256 in t.encode("a <|endoftext|> b", add_special_tokens=False).ids
    r = np.random.default_rng(1)
    for _ in range(400):
        text = "".join(r.choice(list("ab1'.  \n\t  \x1c\x85é漢<|"), r.integers(0, 30)))
        assert e.encode(text).tolist() == t.encode(text, add_special_tokens=False).ids, repr(text)
    long = "ab cd  \n e" * 250_000
    assert e.encode(long).tolist() == t.encode(long, add_special_tokens=False).ids


def test_token_lookup(spark, small):
    from lucera.llm.common import new_path

    path = new_path(spark, "lookup")
    token_files.write_tokens(spark.read.parquet(f"{small}/documents.parquet"), path, public_tokenizers.path("byte_bpe_50k.json"))
    found = token_files.lookup(spark, path, [3, 77])
    assert {r["doc_id"] for r in found.collect()} == {3, 77}
    assert "PushedFilters: [In(doc_id" in found._jdf.queryExecution().toString() or "doc_id IN" in found._jdf.queryExecution().toString()


def test_lookups_skip_stripes(spark, tmp_path):
    from pyspark.sql import functions as F

    docs = spark.range(40_000).select(F.col("id").alias("doc_id"), F.concat_ws(" ", F.md5(F.col("id").cast("string")), F.sha2(F.col("id").cast("string"), 512)).alias("text")).coalesce(1)
    path = str(tmp_path / "t")
    token_files.write_tokens(docs, path, public_tokenizers.path("byte_bpe_50k.json"), **{"orc.stripe.size": "200000", "orc.row.index.stride": "1000", "orc.stripe.row.count": "5000"})

    def rows_read(condition):
        df = spark.read.orc(path).filter(condition)
        found = df.count() if condition == "true" else len(df.collect())
        leaf = df._jdf.queryExecution().executedPlan().collectLeaves().head()
        return found, leaf.metrics().apply("numOutputRows").value()

    assert rows_read("doc_id = 20000")[0] == 1 and rows_read("doc_id = 20000")[1] <= 5000
    # within every stripe's range of ids, but in no Bloom filter
    docs.withColumn("doc_id", F.col("doc_id") * 2).createOrReplaceTempView("even_ids")
    path = str(tmp_path / "even")
    token_files.write_tokens(spark.table("even_ids"), path, public_tokenizers.path("byte_bpe_50k.json"), **{"orc.row.index.stride": "1000", "orc.stripe.row.count": "5000"})
    assert rows_read("doc_id = 40001")[0] == 0 and rows_read("doc_id = 40001")[1] == 0


def test_bpe(spark, data):
    import tiktoken

    b = bpe.Bpe(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    enc = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=b.ranks, special_tokens={})
    expect = []
    for d, text in docs_of(spark, data):
        ids = enc.encode_ordinary(text or "")
        expect.append((d, len(ids), sha(np.array(ids, "<u4").tobytes()), sha((text or ""))))
    assert sorted(tuple(r) for r in run(spark, "op7_bpe", data)) == sorted(expect)


def test_bpe_chunks_resynchronise():
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    r = np.random.default_rng(2)
    tiny = bpe.Bpe(path, chunk=16, overlap=6)
    for k in range(400):
        alphabet = list("ab1'.s  \n\t é漢") if k % 2 else list("a  \n")
        text = "".join(r.choice(alphabet, r.integers(0, 200)))
        assert tiny.boundaries(text) == [m.end() for m in tiny.pattern.finditer(text)], repr(text)
        assert tiny.encode(text) == tiny.encoding.encode_ordinary(text), repr(text)
        assert tiny.decode(tiny.encode(text)).decode() == text


def test_bpe_of_long_texts_spreads_over_tasks(spark, monkeypatch):
    import tiktoken

    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    enc = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.Bpe(path).ranks, special_tokens={})
    r = np.random.default_rng(7)
    alphabet = list("ab1'.s  \n\té漢")
    texts = [*("".join(r.choice(alphabet, n)) for n in (0, 99, 100, 101, 500, 3000, 3000)), filler(400, 3), "a" * 700, " " * 700, "x" * 300 + " y" * 300, filler(60, 1) + " " * 90 + filler(90, 2), None]
    monkeypatch.setattr(bpe, "SPREAD", 100)
    monkeypatch.setattr(bpe, "WIDE", 64)
    monkeypatch.setattr(bpe, "OVERLAP", 24)
    docs = spark.createDataFrame([(k, t) for k, t in enumerate([*texts, texts[5]])], "doc_id long, text string")
    expect = []
    for d, text in docs.collect():
        ids = enc.encode_ordinary(text or "")
        expect.append((d, len(ids), sha(np.array(ids, "<u4").tobytes()), sha(text or "")))
    work = Work(spark, "longbpe")
    assert sorted(map(tuple, bpe.encoded(docs, path, work).collect())) == expect
    cuts = spark.read.parquet(work.paths["cuts"])
    assert cuts.groupBy("k").count().agg({"count": "max"}).first()[0] > 10


def test_jaccard_join(spark, data):
    rows = run(spark, "op8_ngram_jaccard_join", data)
    docs = docs_of(spark, data)
    texts = defaultdict(list)
    for d, t in docs:
        texts[t or ""].append(d)
    keys = list(texts)
    sets = [shingles(t) for t in keys]
    links, label = {t: len(texts[t]) - 1 for t in keys}, list(range(len(keys)))

    def find(a):
        while label[a] != a:
            a = label[a]
        return a

    for i in range(len(keys)):
        for j in range(i):
            if jaccard(sets[i], sets[j]) >= 0.8:
                links[keys[i]] += len(texts[keys[j]])
                links[keys[j]] += len(texts[keys[i]])
                label[find(i)] = find(j)
    least = {}
    for i, t in enumerate(keys):
        least[find(i)] = min(least.get(find(i), 2**63), *texts[t])
    where = {t: i for i, t in enumerate(keys)}
    expect = sorted((d, least[find(where[t or ""])], links[t or ""]) for d, t in docs)
    assert sorted((r["doc_id"], r["class_id"], r["n_links"]) for r in rows) == expect


def test_jaccard_join_cuts_large_buckets_in_blocks(spark, tmp_path, monkeypatch):
    from helpers import write_tables

    base, rows = filler(80, 5).split(), []
    for d in range(40):
        w = list(base)
        w[d % 20 * 4] = f"v{d}"
        rows.append((d, " ".join(w), "en", "s", 1, "x"))
    path = write_tables(spark, tmp_path / "t", rows)
    whole = sorted(map(tuple, run(spark, "op8_ngram_jaccard_join", path)))
    monkeypatch.setattr(jaccard_join, "BLOCK", 7)
    assert sorted(map(tuple, run(spark, "op8_ngram_jaccard_join", path))) == whole
    s = [shingles(r[1]) for r in rows]
    brute = [(i, sum(jaccard(s[i], s[j]) >= 0.8 for j in range(40) if j != i)) for i in range(40)]
    assert [(d, n) for d, _, n in whole] == brute


def test_substring_dedup_brute_force(spark, data, monkeypatch):
    from lucera.llm import substring_dedup

    docs = [(d, words(t)) for d, t in docs_of(spark, data)]
    first = {}
    for d, w in docs:
        for i in range(len(w) - 49):
            k = tuple(w[i : i + 50])
            first[k] = min(first.get(k, d), d)
    expect = []
    for d, w in docs:
        keep = [True] * len(w)
        for i in range(len(w) - 49):
            if first[tuple(w[i : i + 50])] < d:
                keep[i : i + 50] = [False] * 50
        left = " ".join(x for x, k in zip(w, keep) if k)
        expect.append((d, len(w), len(w) - sum(keep), sha(left)))
    assert sorted(tuple(r) for r in run(spark, "op9_substring_dedup", data)) == sorted(expect)
    monkeypatch.setattr(substring_dedup, "HOT_CONTENTS", 1)
    assert sorted(tuple(r) for r in run(spark, "op9_substring_dedup", data)) == sorted(expect)
    monkeypatch.setattr(substring_dedup, "HOT_CONTENTS", 2000)
    monkeypatch.setattr(substring_dedup, "SHARD_WORDS", 100)
    assert sorted(tuple(r) for r in run(spark, "op9_substring_dedup", data)) == sorted(expect)


def test_least_owner_by_brute_force():
    from lucera.llm.substring_dedup import FMIndex

    r = np.random.default_rng(4)
    fm = FMIndex([np.zeros(1, np.int64)], np.zeros(1))
    for n in (1, 5, 64, 65, 700, 5000):
        v = r.integers(0, 10**6, n).astype(np.int32)
        fm._least(v)
        lo = r.integers(0, n, 300)
        hi = np.minimum(n, lo + 1 + r.integers(0, r.integers(1, n + 1, 300)))
        assert fm.least(lo, hi).tolist() == [v[a:b].min() for a, b in zip(lo, hi, strict=True)]


def test_nothing_is_removed_without_the_search(spark, small, monkeypatch):
    from lucera.llm import substring_dedup

    real = sum(r["n_removed"] for r in run(spark, "op9_substring_dedup", small))

    def none(batches):
        import pyarrow as pa

        for _ in batches:
            yield pa.RecordBatch.from_pylist([], pa.schema([("kind", pa.int32()), ("h", pa.int64()), ("c", pa.int64()), ("f", pa.int32()), ("t", pa.int32()), ("own", pa.bool_())]))

    monkeypatch.setattr(substring_dedup, "_search", none)
    assert real > 0 and sum(r["n_removed"] for r in run(spark, "op9_substring_dedup", small)) == 0


def test_fm_index_by_brute_force():
    from lucera.llm.substring_dedup import Shard

    r = np.random.default_rng(3)
    for _ in range(60):
        seqs = [r.integers(0, 3, r.integers(1, 90)) for _ in range(r.integers(1, 8))]
        owners = r.integers(-5, 5, len(seqs))
        shard = Shard(seqs, owners)
        other = r.integers(0, 4, 40)
        masks = shard.matched([*seqs, other], np.array([*owners, 3]), 4)
        for a, hit in enumerate(masks.pop().tolist()):
            assert hit == any(owners[j] < 3 and other[a : a + 4].tolist() in [t[k : k + 4].tolist() for k in range(len(t) - 3)] for j, t in enumerate(seqs))
        assert all(m.all() for m in shard.matched(seqs, owners + 1, 4))
        got = masks
        for i, s in enumerate(seqs):
            for a in range(len(s) - 3):
                want = any(owners[j] < owners[i] and s[a : a + 4].tolist() in [t[k : k + 4].tolist() for k in range(len(t) - 3)] for j, t in enumerate(seqs))
                assert got[i][a] == want


def test_archives(spark, odd):
    rows = sorted((tuple(r) for r in run(spark, "op10_warc_zip", odd)), key=str)
    pages = [(r["page_id"], (r["html"] or "").encode()) for r in spark.read.parquet(f"{odd}/pages.parquet").collect()]
    least = {}
    for p, h in pages:
        if len(h) >= 100 and p is not None:
            least[h] = min(least.get(h, p), p)
    expect = [(p, len(h), sha(h), "response" if least.get(h, p) == p else "revisit", None if least.get(h, p) == p else least[h]) for p, h in pages]
    assert rows == sorted(expect, key=str)


@pytest.mark.parametrize("force64", [False, True])
def test_zip_is_standard(force64):
    import io
    import zipfile

    out = io.BytesIO()
    z = warc_zip.ZipWriter(out, force64)
    for k in range(3):
        z.add(f"archive/{k}.bin", bytes([k]) * (k * 1000 + 1))
    z.close()
    data = out.getvalue()
    with zipfile.ZipFile(io.BytesIO(data)) as theirs:
        assert theirs.testzip() is None and theirs.read("archive/2.bin") == b"\x02" * 2001
    ours = warc_zip.ZipReader(lambda a, n: data[a : a + n], len(data))
    assert ours.member("archive/1.bin") == b"\x01" * 1001


def test_archives_zip64_round_trip(spark, odd, tmp_path):
    pages = warc_zip.with_revisits(spark.read.parquet(f"{odd}/pages.parquet"), Work(spark, "zip64"))
    manifest = warc_zip.write_archives(pages, str(tmp_path / "z"), True).collect()
    df = spark.createDataFrame(manifest, "name string, member string, records long")
    assert sum(r["records"] for r in manifest) == warc_zip.read_archives(df, str(tmp_path / "z")).count() == pages.count()


def test_members_of_an_archive_spread_over_tasks(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(warc_zip, "MEMBER_BYTES", 1000)
    pages = spark.createDataFrame([(k, "u", f"<p>{filler(40, k % 90)}</p>") for k in range(100)], "page_id long, url string, html string").coalesce(1)
    rows = warc_zip.with_revisits(pages, Work(spark, "spread")).coalesce(1)
    manifest = spark.createDataFrame(warc_zip.write_archives(rows, str(tmp_path / "z")).collect(), "name string, member string, records long")
    assert manifest.select("name").distinct().count() == 1 < manifest.count()
    got = warc_zip.read_archives(manifest, str(tmp_path / "z"))
    assert got.rdd.getNumPartitions() > 1
    assert sorted((r["page_id"], r["record_type"], r["refers_to"]) for r in got.collect()) == [(k, "revisit" if k >= 90 else "response", k - 90 if k >= 90 else None) for k in range(100)]
