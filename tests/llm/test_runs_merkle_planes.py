"""Periodic runs, Merkle manifests and id planes against brute force, on awkward rows."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict
from fractions import Fraction

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from sourcesift.llm import merkle, periodic_runs, queries, token_planes
from sourcesift.llm.storage import ship

WORD = r"[^\x20\x09-\x0D]+"
COLUMNS = "doc_id long, source string, lang string, n_chars long, text string, runs int, leaf string, n long, rank int, grp string, node string, start string"


@pytest.fixture(autouse=True)
def shipped(spark):
    ship(spark)


@pytest.fixture
def folder(spark, tmp_path):
    """(doc_id, source, text) rows as documents.parquet, with columns whose names clash with those of the operators."""

    def make(rows):
        full = [(i, s, None if i == 3 else "en", None if t is None else len(t), t, 7, "x", 7, 7, "g", "n", "s") for i, s, t in rows]
        spark.createDataFrame(full, COLUMNS).repartition(3).write.mode("overwrite").parquet(f"{tmp_path}/documents.parquet")
        return str(tmp_path)

    return make


def corpus(seed=4, n=80):
    rng = random.Random(seed)
    words = ["a", "b", "the", "Été", "日本", "don't", "x.y", "😀", "<|endoftext|>", "é", " ", "\x85"] + [f"w{i}" for i in range(60)]
    rows = [(0, "s", None), (1, "s", ""), (2, None, " \t\n\x0b"), (3, "s", "one"), (None, "s", "no id"), (None, None, None), (None, "s", "no id")]
    for i in range(4, n):
        text = [rng.choice(words) for _ in range(rng.randint(1, 120))]
        for _ in range(rng.randint(0, 3)):
            unit = rng.choices(words[: rng.choice([2, 10, 40])], k=rng.randint(1, 9))
            at = rng.randint(0, len(text))
            text[at:at] = (unit * rng.randint(2, 9))[: rng.randint(1, 60)]
        rows.append((i, rng.choice(["s", "s", "s", "t", "", None, "é", "Z"]), rng.choice([" ", "\n", " \t "]).join(text)))
    return rows + [rows[20]] * 5 + [(20, "s", "another text with an id of its own")]


def words_of(key, text):
    w = re.findall(WORD, text or "")
    if key is None or not w or zlib.crc32(str(key).encode()) % 10:
        return w
    g, n = zlib.crc32(str(key).encode()) // 10, len(w)
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]


def brute_runs(w):
    out, n = [], len(w)
    for q in range(1, n // 4 + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and w[j] == w[j + q]:
                j += 1
            size = j - i + q
            if size >= max(6, 4 * q) and not any(q % p == 0 and w[i : i + size - p] == w[i + p : i + size] for p in range(1, q)):
                out.append((i, size, q))
            i = max(j, i + 1)
    return sorted(out, key=lambda r: (r[0], r[2]))


def brute_row(key, text):
    w = words_of(key, text)
    runs = brute_runs(w)
    gone = {i for a, size, q in runs for i in range(a + q, a + size)}
    best = max(runs, key=lambda r: (Fraction(r[1], r[2]), -r[0], -r[2])) if runs else None
    lines = "".join(f"{a},{size},{q}\n" for a, size, q in runs)
    kept = " ".join(x for i, x in enumerate(w) if i not in gone)
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    return (key, len(runs), *(best or (None,) * 3), 1000 * best[1] // best[2] if best else None, sha(lines), sha(kept))


def test_runs_of_documents(spark, folder):
    rows = corpus()
    want = Counter(brute_row(i, t) for i, _, t in rows)
    assert sum(n for k, n in want.items() if k[1]) > 20
    assert Counter(tuple(r) for r in queries.op11_periodic_runs(spark, folder(rows)).collect()) == want
    assert queries.op11_periodic_runs(spark, folder([])).count() == 0


def test_run_search_on_few_words_and_any_split_of_lags():
    rng = random.Random(2)
    for _ in range(400):
        docs = []
        for _ in range(rng.randint(1, 4)):
            x = []
            for _ in range(rng.randint(0, 6)):
                unit = [rng.randrange(rng.choice([1, 2, 3, 10])) for _ in range(rng.randint(1, 12))]
                x += (unit * rng.randint(1, 9))[: rng.randint(1, 80)]
            docs.append(x)
        flat = np.array([a for d in docs for a in d], np.int64)
        doc = np.array([i for i, d in enumerate(docs) for _ in d], np.int64)
        want, at = [], 0
        for d in docs:
            want += [(a + at, a + size + at, q) for a, size, q in brute_runs(d)]
            at += len(d)
        for short in (1, 4, 32):
            assert sorted(periodic_runs.find_in(flat, doc, short=short)) == sorted(want)


def test_runs_of_a_long_text(spark):
    noise = [f"n{i}" for i in range(200_000)]
    text = " ".join([*noise, *([f"u{i}" for i in range(5000)] * 5), *noise, *(["z"] * 70_000)])
    docs = spark.createDataFrame([(1, text)], "doc_id long, text string")
    row = periodic_runs.periodic_runs(docs).first()
    assert [tuple(r) for r in row.runs] == [(200_000, 25_000, 5000), (425_000, 70_000, 1)]
    assert row.n_words == 495_000 and len(row.collapsed_text.split()) == 495_000 - 20_000 - 69_999


def brute_manifest(rows):
    h = lambda parts: hashlib.sha256("".join(parts).encode()).hexdigest()
    leaf = lambda r: h(["-" if v is None else f"{len(str(v).encode())}:{v}" for v in r])

    def tree(nodes):
        levels = [nodes]
        while len(levels[-1]) > 1:
            levels.append([h(levels[-1][i : i + 3]) for i in range(0, len(levels[-1]), 3)])
        return levels

    def path(levels, i):
        out = []
        for level in levels[:-1]:
            run = level[i // 3 * 3 : i // 3 * 3 + 3]
            out.append((i % 3, run[: i % 3] + run[i % 3 + 1 :]))
            i //= 3
        return out

    by = defaultdict(list)
    for i, s, t in rows:
        r = (i, s, None if i == 3 else "en", None if t is None else len(t), t)
        by[s].append((i is not None, i or 0, leaf(r), r))
    names = sorted(by, key=lambda s: (s is not None, (s or "").encode()))
    trees = {s: tree([x[2] for x in sorted(by[s], key=lambda x: x[:3])]) for s in names}
    top = tree([trees[s][-1][0] for s in names])
    out = []
    for k, s in enumerate(names):
        for j, (_, _, digest, r) in enumerate(sorted(by[s], key=lambda x: x[:3])):
            steps = path(trees[s], j) + path(top, k)
            changed = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 2 == 0 and r[4] is not None
            node = leaf((*r[:4], r[4].replace("\n", ""))) if changed else digest
            for place, others in steps:
                node = h([*others[:place], node, *others[place:]])
            proof = h([x for _, others in steps for x in others])
            out.append((r[0], digest, trees[s][-1][0], top[-1][0], proof, node, node == top[-1][0]))
    return out


@pytest.mark.parametrize("levels", [6, 2])
def test_manifest_and_proofs(spark, folder, monkeypatch, levels):
    monkeypatch.setattr(merkle, "LEVELS", levels)  # with two levels a page, trees of these rows have several pages
    monkeypatch.setattr(merkle, "SPAN", 3**levels)
    rows = corpus() if levels == 6 else corpus() + [(1000 + i, f"lone{i}", "x\ny") for i in range(30)]
    want = Counter(brute_manifest(rows))
    assert len({k[-1] for k in want}) == 2
    assert Counter(tuple(r) for r in queries.op12_merkle(spark, folder(rows)).collect()) == want


def test_manifest_of_one_row_and_of_none(spark, folder):
    rows = [(7, "s", "a\nb")]
    assert [tuple(r) for r in queries.op12_merkle(spark, folder(rows)).collect()] == brute_manifest(rows)
    assert queries.op12_merkle(spark, folder([])).count() == 0


def test_proofs_of_some_leaves(spark, folder):
    docs = spark.read.parquet(f"{folder(corpus())}/documents.parquet")
    manifest = merkle.build_manifest(docs, ["doc_id", "text"], "source", "doc_id", {"doc_id": F.col("doc_id")})
    wanted = manifest.leaves.filter("rank % 5 = 0").select("grp", "rank")
    more = wanted.unionByName(wanted).unionByName(spark.sql("SELECT 's' AS grp, 100000L AS rank UNION ALL SELECT 'none', 0L"))
    got = merkle.proofs(manifest, more)
    climbed = got.withColumn("top", merkle.climbed(F.col("leaf"), F.col("proof"))).collect()
    assert len(climbed) == wanted.count() and all(r.top == manifest.root and r.reached == r.leaf for r in climbed)


def brute_ids(rows, path):
    import tokenizers

    tokenizer = tokenizers.Tokenizer.from_file(path)
    known = sorted((r for r in rows if r[0] is not None), key=lambda r: r[0])
    return [(i, tokenizer.encode(t or "", add_special_tokens=False).ids + [1]) for i, _, t in known]


def test_id_planes_round_trip(spark, tmp_path):
    path = queries.tokenizer_path("word_bpe_49k.json")
    rows = [r for r in corpus() if r[0] != 20]
    docs = spark.createDataFrame([(i, t, "x", 1) for i, _, t in rows], "doc_id long, text string, start string, file int").repartition(4)
    want = dict(brute_ids(rows, path))
    for i, planes in enumerate(("bit", "byte")):
        got = token_planes.encode_documents(docs, path, f"file://{tmp_path}/{planes}", planes=planes, block_ids=64, file_ids=1 << 8 + i).collect()
        assert Counter(r.doc_id for r in got) == Counter(i for i, _, _ in rows)
        at = 0
        for r in sorted(got, key=lambda r: r.start):
            assert r.start == at and r.n_tokens == len(r.ids) and r.ids_crc32 == zlib.crc32(np.array(r.ids, "<u4").tobytes())
            assert r.doc_id is None or r.ids == want[r.doc_id]
            at += r.n_tokens
        order = [r.doc_id for r in sorted(got, key=lambda r: r.start)]
        assert order == sorted(order, key=lambda i: (i is not None, i or 0))
    index = spark.read.parquet(f"file://{tmp_path}/bit/index").collect()
    assert len(index) > 4 and sum(r.n_docs for r in index) == len(rows)


def test_a_block_is_read_alone(spark, tmp_path):
    ids = [np.arange(n, dtype=np.uint32) * 7919 % (1 << 31) for n in (5, 0, 1000, 64, 1)]
    store = pa.fs.LocalFileSystem() if hasattr(pa, "fs") else __import__("pyarrow.fs", fromlist=["fs"]).LocalFileSystem()
    writer = token_planes.PlaneWriter(store.open_output_stream(f"{tmp_path}/f"), "bit", 100)
    for i, x in enumerate(ids):
        writer.add(i or None, x)
    writer.close()
    with store.open_input_file(f"{tmp_path}/f") as file:
        reader = token_planes.PlaneReader(file)
        whole = np.concatenate(ids)
        assert (reader.read_block(3) == whole[300:400]).all() and len(reader.index) == 11
        assert all((a == b).all() for a, b in zip(reader.documents(), ids, strict=True))
        assert reader.known.tolist() == [False, True, True, True, True]


def test_query_and_empty_table_of_ids(spark, folder):
    rows = [r for r in corpus() if r[0] not in (None, 20)] + [(5000, "s", "the end " * 300_000)]
    got = sorted(tuple(r) for r in queries.op13_token_planes(spark, folder(rows)).collect())
    want, at = [], 0
    for i, ids in brute_ids(rows, queries.tokenizer_path("word_bpe_49k.json")):
        want.append((i, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    assert got == want
    assert queries.op13_token_planes(spark, folder([])).count() == 0


def test_pieces_are_encoded_as_whole_texts_are():
    import tokenizers

    rng = random.Random(9)
    for name in ("word_bpe_49k.json", "byte_bpe_50k.json"):
        path = queries.tokenizer_path(name)
        whole, encode = tokenizers.Tokenizer.from_file(path), token_planes._encoder(path)
        parts = list(" \t\n\x0b\x0c\r\x1c\x85 　aZé̸́ΣςİſK'12²日하😀‍_<>=.,!\"-$") + ["'s", "'LL", "<|endoftext|>", "<|startoftext|>", "<|"]
        texts = ["".join(rng.choices(parts, k=rng.randint(0, 14))) for _ in range(3000)] + [None]
        for text, ids in zip(texts, encode(pa.array(texts)), strict=True):
            assert ids.tolist() == whole.encode(text or "", add_special_tokens=False).ids, repr(text)


def test_words_go_to_the_pool_in_bulk():
    pool = token_planes._Pool()
    assert pool.put([], np.zeros(0, np.uint32), np.zeros(0, np.int64)).tolist() == []
    assert pool.put(["a", "", "b"], np.array([5, 6, 7], np.uint32), np.array([2, 0, 1])).tolist() == [0, 1, 2]
    assert pool.put(["c"], np.array([8, 9], np.uint32), np.array([2])).tolist() == [3]
    assert pool.find(["b", "x", "c", ""]).tolist() == [2, -1, 3, 1]
    ids, sizes = pool.get(np.array([3, 1, 0, 3]))
    assert ids.tolist() == [8, 9, 5, 6, 8, 9] and sizes.tolist() == [2, 0, 2, 2]
