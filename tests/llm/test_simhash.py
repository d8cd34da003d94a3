"""SimHash near-dedup against brute force over all pairs of fingerprints."""

import random
import re

import numpy as np
import xxhash

import ledgerops.llm.simhash as H
from conftest import SF_SMALL
from ledgerops.llm.common import component_labels, connected_components, read_table
from odd_rows import no_docs, odd_docs  # noqa: F401


def brute_fingerprint(text, size=3):
    words = [w for w in re.split(rb"[\x20\x09-\x0D]+", (text or "").encode().lower()) if w]
    if not words:
        return 0
    shingles = [b" ".join(words[i:i + size]) for i in range(max(1, len(words) - size + 1))]
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << i for i in range(64) if 2 * sum(h >> i & 1 for h in hashes) > len(hashes))


def brute_components(ids, fps, max_bits):
    fps = np.array(fps, np.uint64)
    a, b = np.nonzero(np.bitwise_count(fps[:, None] ^ fps[None, :]) <= max_bits)
    label = component_labels(len(fps), a, b)
    low = {}
    for i, c in zip(ids, label):
        low[c] = min(low.get(c, i), i)
    return [low[c] for c in label]


def test_golay_code_is_perfect_and_keys_cover_one_bit():
    tables = H._golay_tables()
    assert len({int(e) for e in tables[1]}) == 2048 and max(int(e).bit_count() for e in tables[1]) == 3
    words = np.random.default_rng(1).integers(0, 1 << 23, 2000)
    index = H.golay_index(words, tables)
    assert len(np.unique(index)) > 1000 and index.max() < 4096
    # a word's corrected form has no error left
    synd, error = tables
    fixed = words ^ error[synd[0][words & 255] ^ synd[1][(words >> 8) & 255] ^ synd[2][words >> 16]]
    assert (synd[0][fixed & 255] ^ synd[1][(fixed >> 8) & 255] ^ synd[2][fixed >> 16] == 0).all()


def test_every_pair_within_two_bits_shares_a_key():
    rng = random.Random(2)
    for _ in range(400):
        x = rng.getrandbits(64)
        y = x
        for b in rng.sample(range(64), rng.randint(0, 2)):
            y ^= 1 << b
        place, key = H.fuzzy_keys(np.array([x, y], np.uint64), 2)
        assert set(key[place == 0].tolist()) & set(key[place == 1].tolist())


def test_links_of_large_groups_equal_those_of_all_pairs(monkeypatch):
    rng = random.Random(4)
    centre = rng.getrandbits(64)
    fps = set()
    while len(fps) < 300:
        x = centre
        for b in rng.sample(range(64), rng.randint(0, 5)):
            x ^= 1 << b
        fps.add(x)
    fps = np.array(sorted(fps), np.uint64)
    a = component_labels(300, *H.links_within(fps, 2))
    monkeypatch.setattr(H, "PAIR_BLOCK", 50)
    for bits in (0, 1, 2):
        b = component_labels(300, *H.links_within(fps, bits))
        want = np.nonzero(np.bitwise_count(fps[:, None] ^ fps[None, :]) <= bits)
        assert (b == component_labels(300, *want)).all()
    assert (a == component_labels(300, *want)).all()


def test_query_matches_brute_force(spark):
    rows = read_table(spark, SF_SMALL, "documents").orderBy("doc_id").collect()
    fps = [brute_fingerprint(r["text"]) for r in rows]
    want = brute_components([r["doc_id"] for r in rows], fps, 2)
    got = {r["doc_id"]: r for r in H.op10_simhash_near_dedup(spark, SF_SMALL).collect()}
    assert len(got) == len(rows)
    for r, f, c in zip(rows, fps, want):
        assert (got[r["doc_id"]]["fingerprint"], got[r["doc_id"]]["component_id"]) == (f"{f:016x}", c)


def test_chains_of_near_copies_are_one_component(spark):
    rng = random.Random(9)
    words = [rng.choice("abcdefgh") * rng.randint(1, 6) for _ in range(400)]
    docs = []
    for i in range(40):
        words = list(words)
        words[rng.randrange(400)] = f"w{i}"
        docs.append((i, " ".join(words)))
    docs += [(100 + i, docs[3][1]) for i in range(30)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    fps = [brute_fingerprint(t) for _, t in docs]
    for bits in (0, 1, 2):
        want = dict(zip([i for i, _ in docs], brute_components([i for i, _ in docs], fps, bits)))
        assert {r["doc_id"]: r["component_id"] for r in H.simhash_components(df, 3, bits).collect()} == want
    assert {r["doc_id"] for r in H.keep_one_per_component(df).collect()} == set(
        brute_components([i for i, _ in docs], fps, 2))


def test_components_of_random_links_and_long_paths(spark):
    rng = np.random.default_rng(7)
    links = [(int(a), int(b)) for a, b in rng.integers(0, 400, (300, 2))] + [(i, i + 1) for i in range(1000, 1100)] + [(5, 5)]
    want = component_labels(1101, np.array([a for a, _ in links]), np.array([b for _, b in links]))
    got = {r["node"]: r["component"] for r in connected_components(spark.createDataFrame(links, "a long, b long")).collect()}
    nodes = {x for a, b in links if a != b for x in (a, b)}
    assert got == {n: int(want[n]) for n in nodes}


def test_odd_rows(odd_docs, no_docs):
    rows = H.simhash_components(odd_docs).collect()
    assert len(rows) == 11
    of = {}
    for r in rows:
        of.setdefault(r["doc_id"], set()).add((r["fp"], r["component_id"]))
    assert of[2] == of[3] == of[5] == {(0, 2)}  # no words: fingerprint zero, linked like any other
    assert {c for _, c in of[None]} == {1} and len(of[4]) == 2
    kept = H.keep_one_per_component(odd_docs)
    assert kept.columns == odd_docs.columns
    # the copies of document 1 under doc_id 4 and under no doc_id go, the other text of doc_id 4 stays
    assert sorted((r["doc_id"], r["text"][:7] if r["text"] else r["text"]) for r in kept.collect()) == [
        (1, "the qui"), (2, None), (4, "another"), (6, "naïve c"), (7, "xxxxxxx"), (8, "word wo")]
    assert H.simhash_components(no_docs).collect() == [] and H.keep_one_per_component(no_docs).collect() == []


def test_one_row_of_each_group_stays(spark):
    """Repeated and null doc_ids: nothing clean is lost, and of a group of copies exactly one row stays."""
    x, y, clean = ("some words that stand in more than one row of this table " * 3 + w for w in ("x", "y", "different one here"))
    rows = [(1, x, 0), (2, x, 1), (2, clean, 2), (None, x, 3), (None, x, 4), (5, clean + " z q", 5), (6, y + " other", 6), (6, y + " other", 7),
            (6, y + " other", 8), (None, "alone without an id at all", 9), (None, "alone without an id at all", 9)]
    df = spark.createDataFrame(rows, "doc_id long, text string, `_t1` int")
    fps = [brute_fingerprint(t) for _, t, _ in rows]
    group = brute_components(list(range(len(rows))), fps, 2)
    kept = H.keep_one_per_component(df)
    got = kept.collect()
    assert kept.schema == df.schema and len(got) == len(set(group))
    of_text = {t: g for (_, t, _), g in zip(rows, group)}
    by_group = {of_text[r["text"]]: r for r in got}
    assert len(by_group) == len(got)
    for g in set(group):
        ids = [i for (i, _, _), h in zip(rows, group) if h == g]
        assert by_group[g]["doc_id"] == min((i for i in ids if i is not None), default=None)
