import random
from collections import defaultdict

import numpy as np
import pandas as pd
import pytest
from samples import ODD_TEXTS

from riskframe.llm import hyperminhash
from riskframe.llm.shingles import WordHashes, mix, shingle_set


def words_of(text):
    return (text or "").encode().lower().split()


def plain_set(text, width):
    words = words_of(text)
    if not words:
        return frozenset()
    width = min(width, len(words))
    return frozenset(tuple(words[i : i + width]) for i in range(len(words) - width + 1))


def reference(docs, width, percent):
    """(doc_id, n_shingles, smallest reachable id) by comparing all sets that share a shingle."""
    sets = [plain_set(t, width) for _, t in docs]
    holders = defaultdict(list)
    for i, s in enumerate(sets):
        for shingle in s:
            holders[shingle].append(i)
    parent = list(range(len(docs)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, s in enumerate(sets):
        shared = defaultdict(int)
        for shingle in s:
            for j in holders[shingle]:
                if j > i:
                    shared[j] += 1
        for j, n in shared.items():
            if 100 * n >= percent * (len(s) + len(sets[j]) - n):
                a, b = find(i), find(j)
                parent[max(a, b)] = min(a, b)
    members = defaultdict(list)
    for i in range(len(docs)):
        members[find(i)].append(docs[i][0])
    smallest = {k: min((d for d in m if d is not None), default=None) for k, m in members.items()}
    return sorted(((d, len(sets[i]), smallest[find(i)]) for i, (d, _) in enumerate(docs)), key=str)


def found(df, width, percent=80):
    rows = hyperminhash.near_duplicates(df, width, percent).collect()
    assert all(r.kept == (r.doc_id == r.component_id) for r in rows)
    return sorted(((r.doc_id, r.n_shingles, r.component_id) for r in rows), key=str)


def near_copies(rng, n, length, vocabulary, changes, first):
    base = [rng.choice(vocabulary) for _ in range(length)]
    out = []
    for i in range(n):
        words = list(base)
        for _ in range(rng.randint(0, changes)):
            words[rng.randrange(length)] = rng.choice(vocabulary)
        out.append((first + i, " ".join(words)))
    return out


@pytest.mark.parametrize("width", [2, 5])
def test_documents(spark, sf_small, width):
    df = spark.read.parquet(f"{sf_small}/documents.parquet")
    docs = [(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()]
    assert found(df, width) == reference(docs, width, 80)


def test_large_groups_and_short_texts(make_docs, monkeypatch):
    monkeypatch.setattr(hyperminhash, "BLOCK", 64)  # large buckets fall into several blocks
    rng = random.Random(8)
    vocabulary = [f"w{i}" for i in range(400)]
    docs = near_copies(rng, 300, 90, vocabulary, 14, 0)  # a fringe around the threshold
    docs += near_copies(rng, 100, 12, vocabulary, 1, 1_000)
    docs += [(2_000 + i, "the very same text in many rows") for i in range(300)]
    docs += [(3_000 + i, " ".join(rng.choice(vocabulary[:3]) for _ in range(rng.randint(1, 4)))) for i in range(200)]
    rng.shuffle(docs)
    assert found(make_docs(docs), 2) == reference(docs, 2, 80)


def test_odd_rows(make_docs):
    rows = found(make_docs(ODD_TEXTS), 2)
    assert [r for r in rows if r[1]] == [r for r in reference(ODD_TEXTS, 2, 80) if r[1]]
    assert [r for r in rows if not r[1]] == [(1, 0, 1), (2, 0, 2), (3, 0, 3)]


def test_empty_table(make_docs):
    assert found(make_docs([]), 5) == []
    assert found(make_docs([(1, None), (2, "")]), 5) == [(1, 0, 1), (2, 0, 2)]


def test_one_of_each_keeps_columns(make_docs):
    docs = make_docs([(3, "a b c d e f g h"), (2, "a b c d e f g h"), (2, "a b c d e f g h"), (4, ""), (5, None), (None, "z")])
    kept = hyperminhash.one_of_each(docs)
    assert kept.columns == docs.columns
    assert sorted((str(r.doc_id), str(r.text)) for r in kept.collect()) == [
        ("2", "a b c d e f g h"), ("4", ""), ("5", "None"), ("None", "z")
    ]


def test_registers_estimate_similarity():
    rng = np.random.default_rng(2)
    for same, own in ((800, 100), (500, 250), (100, 450), (10, 2)):
        errors = []
        for _ in range(40):
            ids = mix(rng.integers(0, 2**62, same + 2 * own, np.uint64))
            a, b = ids[: same + own], np.r_[ids[:same], ids[same + own :]]
            ra, rb = hyperminhash.registers(a), hyperminhash.registers(b)
            errors.append(hyperminhash.corrected_jaccard(ra[None], rb[None], [len(a)], [len(b)])[0][0] - same / (same + 2 * own))
        assert abs(np.mean(errors)) < 0.03


def test_chance_collisions_are_as_expected():
    rng = np.random.default_rng(3)
    n, m, same, used = 4_000, 1_000, 0, 0
    for _ in range(400):
        a, b = (hyperminhash.registers(mix(rng.integers(0, 2**62, k, np.uint64))) for k in (n, m))
        same, used = same + (a == b).sum(), used + len(a)
    expected = n * m / (n + m) ** 2 / (2 * np.log(2) * 2**hyperminhash.MANTISSA_BITS)
    assert abs(same / used - expected) < 4 * np.sqrt(expected / used)


def test_shingles_of_words():
    hashes = WordHashes()
    assert len(shingle_set("A b\ta B", 2, hashes)) == 2
    assert len(shingle_set("one", 2, hashes)) == 1
    assert len(shingle_set(" \x0b\x0c", 2, hashes)) == 0
    assert len(shingle_set("a b", 2, hashes)) == 1  # no ASCII white space, so one word
    assert (shingle_set("É x", 2, hashes) != shingle_set("é x", 2, hashes)).all()


@pytest.mark.parametrize("similarity", [0.8, 0.9, 0.99])
def test_pairs_share_a_band_at_every_size(similarity):
    rng = np.random.default_rng(5)
    for union in (20, 100, 400, 600, 800, 1_000, 1_200, 1_500, 2_000):
        same = int(np.ceil(similarity * union))
        cut = same + (union - same) // 2
        for _ in range(100):
            ids = mix(rng.integers(0, 2**62, union, np.uint64))
            a, b = (hyperminhash.band_keys(hyperminhash.registers(s)) for s in (ids[:cut], np.r_[ids[:same], ids[cut:]]))
            assert (a == b).any(), union


def test_pairs_of_long_texts(make_docs):
    rng = random.Random(12)
    vocabulary = [f"w{i}" for i in range(2_000)]
    docs = []
    for i, length in enumerate((400, 600, 800, 900, 1_000, 1_100, 1_200, 1_500, 2_000) * 8):
        docs += near_copies(rng, 2, length, vocabulary, length // 25, 10 * i)
    assert found(make_docs(docs), 2) == reference(docs, 2, 80)


def test_forest_of_a_block_is_that_of_all_pairs():
    rng = np.random.default_rng(3)
    for _ in range(60):
        base = rng.integers(0, 2**62, 40)
        sets = [np.unique(np.r_[base[rng.random(40) < rng.choice([0.6, 0.9, 1.0])], rng.integers(0, 2**62, rng.integers(1, 6))]) for _ in range(30)]
        comps = rng.integers(0, 12, 30)
        forest = hyperminhash.linked_forest(comps, sets, 80)
        parent = {c: c for c in comps.tolist()}

        def find(parent, c):
            while parent[c] != c:
                c = parent[c]
            return c

        for i in range(30):
            for j in range(i):
                common = len(np.intersect1d(sets[i], sets[j]))
                if 100 * common >= 80 * (len(sets[i]) + len(sets[j]) - common):
                    a, b = find(parent, comps[i]), find(parent, comps[j])
                    parent[max(a, b)] = min(a, b)
        own = {c: c for c in comps.tolist()}
        for a, b in forest:
            a, b = find(own, a), find(own, b)
            assert a != b  # a forest: no pair twice
            own[max(a, b)] = min(a, b)
        assert {c: find(own, c) for c in own} == {c: find(parent, c) for c in parent}


def test_rows_of_a_family_below_the_threshold_grow_with_its_members(spark):
    """Near copies at about 0.63 similarity, none of them linked: no block writes its pairs."""
    rng = np.random.default_rng(4)
    rows = []
    for n in (100, 200):
        base = mix(rng.integers(0, 2**62, 300, np.uint64))
        sets = [np.unique(np.r_[base[rng.random(300) < 0.78], mix(rng.integers(0, 2**62, 5, np.uint64))]) for _ in range(n)]
        frame = pd.DataFrame(
            {
                "class_id": range(n), "component": range(n), "n_shingles": [len(s) for s in sets], "key": 0,
                "block": 0, "home": 0, "registers": [hyperminhash.registers(s).tobytes() for s in sets],
            }
        )
        found = list(hyperminhash._with_candidates(0.8)(iter([frame])))
        rows.append(sum(map(len, found)))
        assert rows[-1] <= n
        shingles = [s.view(np.int64) for s in sets]
        assert hyperminhash.linked_forest(np.arange(n), shingles, 80) == []


def test_of_equal_ids_and_texts_the_same_row_stays(spark):
    rows = [(1, "a b c d e f", "z"), (1, "a b c d e f", "m"), (2, "q", "x"), (2, "q", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    for parts in (1, 3):
        kept = hyperminhash.one_of_each(docs.repartition(parts)).collect()
        assert sorted((r.doc_id, str(r.source)) for r in kept) == [(1, "m"), (2, "None")]


def test_members_of_the_largest_component_lie_in_one_block(spark, monkeypatch):
    monkeypatch.setattr(hyperminhash, "BLOCK", 50)
    rows = [(7, i, 1, 10) for i in range(900)] + [(7, 1_000 + i, 100 + i, 10) for i in range(5)]
    rows += [(8, i, 1, 10) for i in range(900)]  # one component: nothing to compare
    found = hyperminhash.open_members(spark.createDataFrame(rows, "key long, class_id long, component long, n_shingles long"))
    got = found.collect()
    blocks = 19  # of 905 members
    assert {r.key for r in got} == {7} and len(got) == 900 + 5 * blocks
    assert all(r.home == r.block for r in got if r.component == 1)
    assert {(r.class_id, r.block) for r in got if r.component != 1} == {(1_000 + i, b) for i in range(5) for b in range(blocks)}
