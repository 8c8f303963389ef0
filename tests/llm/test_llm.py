"""Each operator against brute force on a small fixture: nulls, empty and long texts, ties, repeats, empty tables."""

import base64
import hashlib
import itertools
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from sourcesift.llm.storage import ship
from sourcesift.llm import anchors, decontamination, embedding_dedup, mixing, ngram_jaccard, sharding, substring_dedup, suffix_dedup, token_counts, toxicity, warc



@pytest.fixture(autouse=True)
def shipped(spark):
    ship(spark)


@pytest.fixture
def docs(spark):
    """(doc_id, text) pairs -> documents with columns whose names clash with those of the operators."""

    def make(*rows):
        schema = "doc_id long, text string, source string, size long, n long, key string, th long, id long, shard int, words string"
        return spark.createDataFrame([(i, t, f"s{i % 3}" if i else None, 7, 7, "k", 7, 7, 7, "w") for i, t in rows], schema)

    return make


WORD = r"[^\x20\x09-\x0D]+"
LOW = {c: c + 32 for c in range(65, 91)}


def corpus(seed=3, n=60):
    rng = random.Random(seed)
    vocabulary = ["alpha", "Beta", "gämma", "delta,", "e", "zeta x", "日本", "😀"] + [f"w{i}" for i in range(300)]
    shared = rng.choices(vocabulary, k=60)
    texts = [None, "", " \t\n", "one", "two words", "a b c d"]
    for _ in range(n):
        words = rng.choices(vocabulary, k=rng.randint(1, 150))
        if rng.random() < 0.4:
            i = rng.randint(0, len(words))
            words[i:i] = shared[rng.randint(0, 20) :]
        texts.append(rng.choice([" ", "\n", "  "]).join(words))
    near = texts[20].split()
    for i in range(6):
        copy = list(near)
        copy[rng.randrange(len(copy))] = "changed%d" % i
        texts.append(" ".join(copy))
    texts += [texts[30], texts[30], " ".join(["echo"] * 400), " ".join(vocabulary * 40)]
    return list(enumerate(texts)) + [(30, texts[30])]


def covered(seq, window, counts):
    gone = np.zeros(len(seq) + 1, int)
    for i in range(len(seq) - window + 1):
        if counts[seq[i : i + window]] > 1:
            gone[i] += 1
            gone[i + window] -= 1
    return np.cumsum(gone)[: len(seq)] > 0


def test_substring_dedup(docs):
    rows = corpus()
    seqs = [tuple(re.findall(WORD, t or "")) for _, t in rows]
    counts = Counter(s[i : i + 35] for s in seqs for i in range(len(s) - 34))
    expected = Counter()
    for (i, _), s in zip(rows, seqs):
        gone = covered(s, 35, counts)
        kept = " ".join(w for w, g in zip(s, gone) if not g)
        expected[(i, len(s), int(gone.sum()), hashlib.sha256(kept.encode()).hexdigest())] += 1
    assert Counter(tuple(r) for r in substring_dedup.dedup_words(docs(*rows)).drop("kept_text").collect()) == expected
    assert substring_dedup.dedup_words(docs(*rows).limit(0)).count() == 0


def test_windows_are_counted_in_parts(docs, monkeypatch):
    copies = [" ".join(f"w{j}" for j in range(i, i + 90)) for i in range(0, 40, 5)]  # windows shared in part
    parts, stored = [], substring_dedup.stored

    def counted(df, *done):
        out = stored(df, *done)
        parts.extend([out.count()] if "lo" in out.columns else [])
        return out

    monkeypatch.setattr(substring_dedup, "stored", counted)
    got = {r.doc_id: r.n_removed for r in substring_dedup.dedup_words(docs(*enumerate(copies))).collect()}
    assert got == {0: 85, 7: 85} | dict.fromkeys(range(1, 7), 90)
    assert len(parts) == substring_dedup.PARTS and max(parts) < sum(parts)


def test_suffix_dedup(docs, monkeypatch):
    rows = corpus(5)
    seqs = [(t or "").encode() for _, t in rows]
    counts = Counter(s[i : i + 200] for s in seqs for i in range(len(s) - 199))
    expected = Counter()
    for (i, _), s in zip(rows, seqs):
        gone = covered(s, 200, counts)
        kept = np.frombuffer(s, np.uint8)[~gone].tobytes()
        spans = int((np.diff(np.append(0, gone.astype(int))) == 1).sum())
        expected[(i, len(s), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest())] += 1
    for most in (1024, 1):  # sorted in a task, and counted by hash
        monkeypatch.setattr(suffix_dedup, "SORTED", most)
        assert Counter(tuple(r) for r in suffix_dedup.dedup_bytes(docs(*rows)).drop("kept").collect()) == expected


def test_contexts_hash_alike_in_every_chunk():
    rng = np.random.default_rng(2)
    first, text = rng.integers(97, 123, 777).astype(np.uint8), rng.integers(97, 123, 600).astype(np.uint8)
    kind = anchors.Units(False, 200, 32)

    def contexts(*parts):
        row, *_, context = anchors.find_anchors(*kind.read(np.concatenate(parts), np.cumsum([0, *map(len, parts)])), kind)
        return context[row == len(parts) - 1].tolist()

    assert contexts(text) == contexts(first, text)


def test_anchors_with_many_contexts_make_no_row_per_window(docs, monkeypatch):
    rng = np.random.default_rng(3)
    letters = lambda n: rng.integers(97, 123, n).astype(np.uint8).tobytes().decode()
    common = letters(420)
    rows = [(i, letters(150) + common + letters(150)) for i in range(60)]
    monkeypatch.setattr(suffix_dedup, "SORTED", 8)
    spans = suffix_dedup.repeated_spans(anchors.keyed(docs(*rows))).collect()
    starts = {i: set() for i, _ in rows}
    for r in spans:
        starts[r.id].update(range(r.lo, r.hi + 1))
    counts = Counter(t[i : i + 200] for _, t in rows for i in range(len(t) - 199))
    assert starts == {i: {s for s in range(len(t) - 199) if counts[t[s : s + 200]] > 1} for i, t in rows}
    assert len(spans) < 60 * 20  # windows at the edges of the passage: over 60 * 60


def test_suffix_sort_is_a_sort():
    rng = np.random.default_rng(1)
    data = rng.integers(97, 99, 4000).astype(np.uint8)
    start = rng.integers(0, 3900, 500)
    s = suffix_dedup.Suffixes(data, start, rng.integers(0, 100, 500))
    group = np.sort(rng.integers(0, 9, 500))
    text = [data[a : a + n].tobytes() for a, n in zip(start, s.size)]
    order = s.sorted_within(group)
    assert [(group[i], text[i]) for i in order] == sorted((g, t) for g, t in zip(group, text))


def test_ngram_jaccard(docs):
    rows = corpus(7)

    def shingles(t):
        w = re.findall(WORD, (t or "").translate(LOW))
        return {tuple(w[i : i + 4]) for i in range(len(w) - 3)} if len(w) >= 4 else {tuple(w)} if w else set()

    sets, parent = [shingles(t) for _, t in rows], list(range(len(rows)))
    for a, b in itertools.combinations(range(len(rows)), 2):
        same = len(sets[a] & sets[b])
        if same and 100 * same >= 85 * (len(sets[a]) + len(sets[b]) - same):
            old, new = parent[b], parent[a]
            parent = [new if p == old else p for p in parent]
    least = {p: min(rows[i][0] for i in range(len(rows)) if parent[i] == p) for p in set(parent)}
    expected = Counter((rows[i][0], len(sets[i]), least[parent[i]]) for i in range(len(rows)))
    assert Counter(tuple(r) for r in ngram_jaccard.near_duplicate_groups(docs(*rows), 4, 85).collect()) == expected
    assert ngram_jaccard.near_duplicate_groups(docs(*rows).limit(0)).count() == 0


def test_ngram_jaccard_leaves_out_pairs_below_the_threshold(docs, monkeypatch):
    # copies with one word changed, in one of 16 places: in different ones 69 of 85 shingles are common, just too few
    words = [f"n{j}" for j in range(80)]
    rows = [(i, " ".join(words[:j] + [f"other{i}"] + words[j + 1 :])) for i, j in enumerate([*range(8, 72, 4)] * 4)]
    pairs, stored = [], ngram_jaccard.stored

    def counted(df, *done):
        out = stored(df, *done)
        pairs.extend([out.count()] if out.columns == ["a", "b"] else [])
        return out

    monkeypatch.setattr(ngram_jaccard, "stored", counted)
    got = ngram_jaccard.near_duplicate_groups(docs(*rows), 4, 85).collect()
    assert Counter(r.component_id for r in got) == {i: 4 for i in range(16)}
    assert sum(pairs) < 6 * len(rows)  # of 2,016


def test_odd_sketches_differ_no_more_than_their_sets():
    rng = np.random.default_rng(2)
    sets = [np.unique(rng.integers(0, 3000, n).astype(np.uint64)) for n in (0, 1, 40, 400, 2500, 2500)] * 700
    at = np.cumsum([0] + [len(x) for x in sets])
    bits = ngram_jaccard.odd_sketches(np.concatenate(sets), at)
    for i, j in itertools.combinations(list(range(6)) + [4198, 4199], 2):
        differ = int(np.bitwise_count(bits[i] ^ bits[j]).sum())
        assert differ <= len(np.setxor1d(sets[i], sets[j]))
    assert (bits[:6] == bits[4194:]).all() and (bits[2] != bits[3]).any()


def test_ngram_jaccard_of_long_columns(docs, monkeypatch):
    monkeypatch.setattr(ngram_jaccard, "SHORT", 2)
    monkeypatch.setattr(ngram_jaccard, "ROUNDS", 1)
    monkeypatch.setattr(ngram_jaccard, "BESIDE", 1)
    test_ngram_jaccard(docs)


def test_ngram_jaccard_keeps_null_ids(docs):
    near = [" ".join(f"n{j}" if j != i else "other" for j in range(60)) for i in (0, 59)]
    lone = " ".join(f"l{j}" for j in range(30))
    rows = [(5, near[0]), (None, near[1]), (None, near[1]), (None, lone), (None, lone), (None, None), (7, "two words")]
    got = Counter(tuple(r) for r in ngram_jaccard.near_duplicate_groups(docs(*rows), 4, 85).collect())
    assert got == Counter([(5, 57, 5), (None, 57, 5), (None, 57, 5), (None, 27, None), (None, 27, None), (None, 0, None), (7, 1, 7)])


def test_one_row_stays_of_each_group(docs):
    near = [" ".join(f"n{j}" if j != i else "other" for j in range(60)) for i in range(0, 60, 7)]
    lone = [" ".join(f"l{i}x{j}" for j in range(30)) for i in range(6)]
    rows = [(1, near[0]), (2, near[1]), (2, lone[0]), (None, near[2]), (None, near[2])]  # one doc_id on two texts
    rows += [(3, lone[1])] * 4 + [(None, lone[2])] * 5 + [(None, lone[3]), (9, lone[3]), (None, lone[4])]  # repeated rows, null ids
    rows += [(None, None), (None, None), (4, ""), (4, "")]  # no words: all stay
    got = ngram_jaccard.keep_one_per_group(docs(*rows), 5, 80)
    assert got.columns == docs(*rows).columns
    stays = [(1, near[0]), (2, lone[0]), (3, lone[1]), (None, lone[2]), (9, lone[3]), (None, lone[4]), (None, None), (None, None), (4, ""), (4, "")]
    assert Counter((r.doc_id, r.text) for r in got.select("doc_id", "text").collect()) == Counter(stays)


def test_token_counts(docs):
    tokenizers, public = pytest.importorskip("tokenizers"), pytest.importorskip("public_tokenizers")
    path = public.path("byte_bpe_50k.json")
    machine = tokenizers.Tokenizer.from_file(path)
    rng = random.Random(2)
    parts = ["a", "s", "'re", "'", "'ll", " ", "  ", "\n", "1", "é", "中", "😀", ".", "<|endoftext|>", "<|endo", "\x85", "²"]
    texts = ["".join(rng.choices(parts, k=rng.randint(0, 30))) for _ in range(3000)] + ["", "x" * 3000, " " * 999]
    assert token_counts.text_token_counts(pa.array(texts), path).tolist() == [len(machine.encode(t, add_special_tokens=False).ids) for t in texts]
    got = {r.doc_id: r for r in token_counts.count_tokens(docs((0, None), (1, "hello world"), (2, "é " * 2000)), path).collect()}
    assert (got[0].n_bytes, got[0].n_tokens, got[1].n_tokens, got[2].over_limit) == (0, 0, 2, True)


def test_mixing(docs):
    rows = corpus(9)
    out = mixing.mix_sources(docs(*rows)).collect()
    sizes = sorted((i, len(re.findall(WORD, t or ""))) for i, t in rows)
    assert sorted((r.doc_id, r["size"]) for r in out) == sizes
    assert all(0 <= r.taken <= 2 * r["size"] for r in out)
    for source in {r.source for r in out}:
        own = [r for r in out if r.source == source]
        assert sum(r["size"] for r in own) == own[0].source_size
        assert abs(sum(r.taken for r in own) - own[0].target) <= 0.05 * own[0].target + 2
    assert sorted(out, key=str) == sorted(mixing.mix_sources(docs(*rows)).collect(), key=str)
    assert mixing.mix_sources(docs(*rows).limit(0)).count() == 0


def test_mixing_of_small_sources_beside_a_large_one(spark):
    # the large source's blocks are of 256 words
    large = spark.range(40).selectExpr("id AS doc_id", "'b' AS source", "repeat('w ', 450000) AS text")
    small = [(100 + i, s, "w " * n) for i, (s, n) in enumerate([("a", 3), ("a", 7), ("c", 20), ("c", 25), ("d", 300), ("d", 5)])]
    out = mixing.mix_sources(large.unionByName(spark.createDataFrame(small, "doc_id long, source string, text string"))).drop("text").collect()
    assert len(out) == 46 and all(0 <= r.taken <= 2 * r["size"] for r in out)
    for source in "abcd":
        own = [r for r in out if r.source == source]
        assert own[0].target > 0 and abs(sum(r.taken for r in own) - own[0].target) <= 0.01 * own[0].target + 1


def test_mixed_documents_keep_null_ids(docs, spark):
    rows = corpus(9) + [(None, " ".join(f"v{i}x{j}" for j in range(40))) for i in range(60)] + [(None, "one same text")] * 7 + [(4, "a b c d")] * 4
    out = Counter((r.doc_id, r.text) for r in mixing.mixed_documents(docs(*rows)).select("doc_id", "text").collect())
    asked = Counter()
    for r in mixing._mixed(docs(*rows)).collect():
        asked[r.doc_id, r.th] += r.taken / max(r["size"], 1)
    texts = spark.createDataFrame(sorted({(t,) for _, t in rows if t is not None}), "text string")
    th = {r.text: r.th for r in texts.selectExpr("text", "xxhash64(text) AS th").collect()} | {None: 42}
    assert set(out) <= set(rows)
    assert all(int(asked[i, th[t]] + 1e-9) <= out[i, t] <= asked[i, th[t]] + 1 for i, t in set(rows))
    words = sum(len(t.split()) * n for (i, t), n in out.items() if i is None)
    wanted = sum(asked[i, th[t]] * len(t.split()) for i, t in set(rows) if i is None)
    assert wanted > 0 and abs(words - wanted) <= 0.15 * wanted


def test_sainte_lague_gives_the_highest_quotients():
    rng = np.random.default_rng(4)
    for _ in range(50):
        votes, seats = rng.integers(1, 1000, 6).astype(float), int(rng.integers(0, 60))
        quotients = sorted(((-v / (2 * k + 1), i) for i, v in enumerate(votes) for k in range(60)))[:seats]
        assert mixing.sainte_lague(votes, seats).tolist() == [sum(i == j for _, i in quotients) for j in range(6)]
    assert mixing.fill_targets(np.array([10, 100]), np.array([3.0, 1.0]), 165, 2).tolist() == [20, 145]


def test_sharding(docs):
    rows = corpus(11)
    out = sharding.shard_documents(docs(*rows), shards=8).collect()
    size = lambda t: len((t or "").encode()) + 16
    assert Counter((r.doc_id, r["size"], r.text_crc32) for r in out) == Counter((i, size(t), zlib.crc32((t or "").encode())) for i, t in rows)
    for shard in range(8):
        assert sorted(r.slot for r in out if r.shard == shard) == list(range(sum(r.shard == shard for r in out)))
    where = {}
    for r in out:
        text = dict(rows)[r.doc_id] or ""
        assert where.setdefault(text, r.shard) == r.shard
    assert sharding.shard_documents(docs(*rows).limit(0)).count() == 0


def test_cuts_have_the_least_largest_shard(spark):
    sizes = [5, 9, 2, 40, 3, 3, 3, 7, 1, 8]
    frame = spark.createDataFrame(list(enumerate(sizes)), "unit int, bytes long")
    for shards in (1, 3, 4, 12):
        got = {r.unit: r.shard for r in sharding.cut_units(frame, shards).collect()}
        assert [got[i] for i in range(10)] == sorted(got.values()) and max(got.values()) < shards
        most = max(sum(s for i, s in enumerate(sizes) if got[i] == k) for k in set(got.values()))
        cuts = itertools.combinations(range(1, 10), min(shards, 10) - 1)
        assert most == min(max(sum(sizes[a:b]) for a, b in zip((0, *c), (*c, 10))) for c in cuts)


def test_decontamination(docs, spark):
    rows = corpus(13)
    long_text = next(t for i, t in rows if t and len(t.split()) > 80)
    items = [(1, long_text.upper()[:400]), (2, "Alpha, BETA"), (10, None), (11, "!!"), (3, "nothing like it in any of the texts at all here")]
    word = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    words = lambda t: tuple(word.findall((t or "").translate(LOW)))
    windows = [(i, w[j : j + n]) for i, t in items if (w := words(t)) and (n := min(10, len(w))) for j in range(len(w) - n + 1)]
    expected = Counter()
    for i, t in rows:
        w, hit, names = words(t), set(), set()
        for item, x in windows:
            for j in range(len(w) - len(x) + 1):
                if w[j : j + len(x)] == x:
                    hit |= set(range(j, j + len(x)))
                    names.add(str(item))
        sha = hashlib.sha256(",".join(sorted(names)).encode()).hexdigest()
        expected[(i, len(w), len(hit), len(names), sha, bool(hit))] += 1
    bench = spark.createDataFrame(items, "item_id long, text string")
    assert Counter(tuple(r) for r in decontamination.find_contamination(docs(*rows), bench).collect()) == expected
    assert decontamination.decontaminate(docs(*rows), bench).count() == sum(n for k, n in expected.items() if not k[5])
    assert decontamination.find_contamination(docs(*rows), bench.limit(0)).filter("contaminated").count() == 0


def test_toxicity(docs, spark):
    rng = random.Random(6)
    clean = [f"c{i}" for i in range(50)]
    rows = [(i, " ".join(rng.choices(clean, k=30) + (["Vilest", "nasty"] if i % 5 == 0 else []))) for i in range(400)] + [(400, None), (401, "")]
    labels = spark.createDataFrame([(i, 1, int(i % 5 == 0)) for i in range(0, 300)] + [(None, 1, 1), (5000, None, None)], "doc_id long, quality int, toxic int")
    chain = toxicity.fit_chain(docs(*rows), labels)
    got = {r.doc_id: r.toxic for r in toxicity.score_documents(docs(*rows), chain).collect()}
    assert sum(got[i] == (i % 5 == 0) for i in range(300, 400)) >= 98 and not got[400] and not got[401]
    kept = toxicity.drop_flagged(docs(*rows), chain)
    assert sorted(r.doc_id for r in kept.collect()) == sorted(i for i, t in got.items() if not t)
    none = toxicity.fit_chain(docs(*rows), labels.limit(0))
    assert toxicity.drop_flagged(docs(*rows), none).count() == len(rows)


def test_warc_round_trip(spark, tmp_path):
    rng = random.Random(8)
    html = ["<p>%s</p>" % ("x" * rng.randint(0, 5000)) for _ in range(40)] + ["", None, "é😀\r\n\r\n", "", "same", "same", "same"]
    rows = [(i, None if i == 3 else f"http://h/{i} \n", t) for i, t in enumerate(html)] + [(None, "u", "lost")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = warc.archive_pages(pages, f"file://{tmp_path}/a", frame_bytes=4000, bundle_bytes=2000).collect()
    first = {}
    for i, t in enumerate(html):
        first.setdefault(t or "", i)
    sha = lambda t: base64.b32encode(hashlib.sha1(t.encode()).digest()).decode()
    assert {(r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got} == {
        (i, len((t or "").encode()), sha(t or ""), "response" if first[t or ""] == i else "revisit", None if first[t or ""] == i else first[t or ""])
        for i, t in enumerate(html)
    }
    assert all(r.payload == (html[r.page_id] or "") for r in got if r.record_type == "response")


def test_embedding_dedup(spark):
    rng = np.random.default_rng(3)
    centre = rng.standard_normal((60, 16))
    near = np.repeat(centre, 8, axis=0) + rng.standard_normal((480, 16)) * 0.12
    vectors = np.concatenate([near, near[:3], near[:1] * 2]).astype(np.float32)
    rows = [(i, [float(x) for x in v], 0) for i, v in enumerate(vectors)]
    odd = [(900, None, 0), (901, [0.0] * 16, 0), (902, [None] + [1.0] * 15, 0), (903, [float("nan")] * 16, 0), (904, [1.0] * 3, 0), (905, [], 0)]
    frame = spark.createDataFrame(rows + odd, "vec_id long, embedding array<float>, label int")
    got = {r.vec_id: r for r in embedding_dedup.near_vectors(frame).collect()}
    unit = vectors.astype(float) / np.linalg.norm(vectors.astype(float), axis=1, keepdims=True)
    links = (unit @ unit.T >= 0.9) & ~np.eye(len(unit), dtype=bool)
    found = np.array([got[i].n_links for i in range(len(unit))])
    assert (found <= links.sum(1)).all() and found.sum() >= 0.95 * links.sum()
    assert all(got[i].n_links == 0 and got[i].component_id == i and got[i].kept for i in range(900, 906))
    assert got[480].component_id == got[0].component_id and not got[480].kept
    assert embedding_dedup.near_vectors(frame.limit(0)).count() == 0


def test_anchors_depend_on_the_window_alone():
    rng = np.random.default_rng(2)
    kind = anchors.Units(False, 40, 8)
    data = rng.integers(97, 101, 300).astype(np.uint8)
    both = np.concatenate([data, rng.integers(97, 101, 77).astype(np.uint8), data])
    one = anchors.find_anchors(*kind.read(data, np.array([0, 300])), kind)
    two = anchors.find_anchors(*kind.read(both, np.array([0, len(both)])), kind)
    assert set(one[4].tolist()) <= set(two[4].tolist())
    assert (one[3] - one[2] + 1).sum() == 261
