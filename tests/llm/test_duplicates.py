"""Suffix-array removal, fuzzy passages and near duplicates against brute force."""

import hashlib
import random

import numpy as np
import pytest

from farsight.llm import near_dup, substring_exact, substring_fuzzy
from farsight.llm.components import connected_components
from farsight.llm.near_dup import drop_near_duplicates, near_duplicates
from farsight.llm.substring_exact import remove_repeats
from farsight.llm.suffix_arrays import common_prefixes, merge_runs, suffix_array


def test_suffix_array_and_prefixes():
    rng = random.Random(3)
    for _ in range(150):
        symbols = np.array([rng.choice([1, 2, 3, 250]) for _ in range(rng.randint(1, 70))] + [0], np.int16)
        order, place = suffix_array(symbols)
        assert order.tolist() == sorted(range(len(symbols)), key=lambda i: tuple(symbols[i:]))
        shared = common_prefixes(symbols, order, place, np.array([0]), np.array([len(symbols) - 1]), 8)
        for slot in range(1, len(symbols)):
            a, b, n = order[slot - 1], order[slot], 0
            while n < 8 and max(a, b) + n < len(symbols) and symbols[a + n] == symbols[b + n] != 0:
                n += 1
            assert shared[slot] == n or order[slot] == len(symbols) - 1


def test_runs_merge_by_binary_search():
    rng = random.Random(1)
    rows = [(bytes(rng.choices(b"ab", k=4)), rng.randint(0, 5), k) for k in range(40)]
    runs = []
    for part in (rows[:13], rows[13:30], rows[30:]):
        first = {}
        for s, d, p in part:
            first[s] = min(first.get(s, (99, 99)), (d, p))
        keys = sorted(first)
        runs.append((np.array(keys, "S4"), np.array([first[k][0] for k in keys]), np.array([first[k][1] for k in keys])))
    flags = merge_runs(runs)
    best = {}
    for s, d, p in (x for r in runs for x in zip(*r)):
        best[s] = min(best.get(s, (99, 99)), (d, p))
    for run, flag in zip(runs, flags):
        assert flag.tolist() == [best[s] != (d, p) for s, d, p in zip(*run)]


def brute(docs, length):
    seen, out = set(), []
    for _, text in docs:
        data = (text or "").encode()
        gone = np.zeros(len(data) + 1, bool)
        for i in range(len(data) - length + 1):
            if data[i : i + length] in seen:
                gone[i : i + length] = True
            seen.add(data[i : i + length])
        kept = bytes(b for b, g in zip(data, gone) if not g)
        out.append((len(data), int(gone.sum()), int((np.diff(gone.astype(int)) == 1).sum() + gone[0]), hashlib.sha256(kept).hexdigest()))
    return out


def block_documents(n, seed=3):
    rng = random.Random(seed)
    blocks = ["".join(rng.choices("abcdé ", k=rng.randint(20, 90))) for _ in range(12)]
    hot = "the very common passage that stands in many documents of it "
    docs = []
    for i in range(n):
        parts = [rng.choice([*blocks, hot, "x" * 50]) if rng.random() < 0.7 else "".join(rng.choices("abcdefgh ", k=rng.randint(1, 60))) for _ in range(rng.randint(0, 10))]
        docs.append((i, "".join(parts)))
    return [*docs, (n, None), (n + 1, ""), (n + 2, "a" * 500), (n + 3, docs[3][1])]


@pytest.mark.parametrize("shard_rows", [None, 60])
def test_removal_equals_brute_force(llm, monkeypatch, shard_rows):
    """Also with shards so small that common anchors span several and are merged."""
    if shard_rows:
        monkeypatch.setattr(substring_exact, "MAX_SYMBOLS", shard_rows * 2 * (2 * 40 - 32 + 1))
    docs = block_documents(500)
    frame = llm.createDataFrame(docs, "doc_id long, text string").repartition(4)
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, hashlib.sha256(r.kept).hexdigest()) for r in remove_repeats(frame, 40).collect()}
    assert [got[d] for d, _ in docs] == brute(docs, 40)


def test_long_texts_are_cut_into_slices_without_loss(llm, monkeypatch):
    monkeypatch.setattr(substring_exact, "SLICE", 300)
    docs = block_documents(60, 8)
    got = {r.doc_id: r.n_removed for r in remove_repeats(llm.createDataFrame(docs, "doc_id long, text string"), 40).collect()}
    assert [got[d] for d, _ in docs] == [b[1] for b in brute(docs, 40)]


def test_removal_of_odd_rows(odd, none):
    out = remove_repeats(odd)
    assert out.columns == ["doc_id", "n_bytes", "n_removed", "n_spans", "spans", "kept"]
    rows = sorted(((r.doc_id if r.doc_id is not None else -1, r.text is not None, r.text or "") for r in odd.collect()))
    want = brute([(d, t) for d, _, t in rows], 100)
    got = sorted((r.doc_id if r.doc_id is not None else -1, r.n_bytes, r.n_removed) for r in out.collect())
    assert got == sorted((d, n, g) for (d, _, _), (n, g, _, _) in zip(rows, want))
    assert remove_repeats(none).count() == 0


def test_windows_of_a_wide_anchor_are_one_sorted_run_per_shard_and_bucket(llm):
    rng = random.Random(4)
    core = bytes(rng.choices(range(97, 123), k=32))
    rows = []
    for k in range(60):
        text = bytes(rng.choices(range(97, 123), k=20)) + core + bytes(rng.choices(range(97, 123), k=20))
        rows.append((k // 20, True, 100 - k, 7, 33, bytearray(text)))
    segments = llm.createDataFrame(rows, "shard long, wide boolean, uid long, start long, windows int, bytes binary")
    found = substring_exact.compare_shards(segments, 40, 4).where("kind = 2").collect()
    assert len(found) == len({(r.shard, r.bucket) for r in found}) <= 12  # before, one row for each of 1,980 windows
    seen = set()
    for r in found:
        strings = [bytes(r.strings[k : k + 40]) for k in range(0, len(r.strings), 40)]
        uids, starts = (np.frombuffer(x, np.int64).tolist() for x in (r.uids, r.starts))
        assert strings == sorted(strings) and len(strings) == len(uids) == len(starts)
        for text, uid, start in zip(strings, uids, starts):
            assert bytes(rows[100 - uid][5][start - 7 :][:40]) == text
            seen.add((uid, start))
    assert len(seen) == 60 * 33


# --- fuzzy passages ---------------------------------------------------------------


def test_fenwick_chain_equals_quadratic_search():
    rng = random.Random(7)
    for _ in range(150):
        blocks = np.array([(rng.randint(0, 80), rng.randint(0, 80), rng.randint(5, 20)) for _ in range(rng.randint(1, 9))])
        order = sorted(range(len(blocks)), key=lambda k: tuple(blocks[k]))
        score = {}
        for k in order:
            x, y, n = blocks[k].tolist()
            best = 0.0
            for j in score:
                a, b, m = blocks[j].tolist()
                if a + m <= x + 5 and b + m <= y + 5 and j != k:
                    best = max(best, score[j] - 0.25 * (x + y - a - m - b - m))
            score[k] = n + best
        top = substring_fuzzy.chain(blocks)[0]
        total = float(blocks[top[0]][2])
        for j, k in zip(top, top[1:]):
            gap = blocks[k][0] + blocks[k][1] - sum(blocks[j]) - blocks[j][2]
            total += blocks[k][2] - 0.25 * gap
        assert total == pytest.approx(max(score.values()))


def test_planted_passages_are_found_and_nothing_else(llm):
    rng = random.Random(5)

    def words(n):
        return [f"w{rng.randint(0, 4000)}" for _ in range(n)]

    def edited(passage, rate):
        return [f"z{rng.randint(0, 9999)}" if rng.random() < rate else w for w in passage if rng.random() > rate / 3]

    passages = [words(75) for _ in range(5)]
    docs, exact, fuzzy = [], set(), set()
    for i in range(150):
        body = words(rng.randint(5, 200))
        if i % 3 == 0:
            body[3:3] = passages[i % 5]
            exact.add(i)
        elif i % 3 == 1:
            body[5:5] = edited(passages[i % 5], 0.04)
            fuzzy.add(i)
        docs.append((i, " ".join(body)))
    pairs = substring_fuzzy.fuzzy_passages(llm.createDataFrame(docs, "doc_id long, text string")).collect()
    found = {r.doc_id for r in pairs} | {r.other_doc_id for r in pairs}
    assert exact <= found <= exact | fuzzy and len(found & fuzzy) >= 0.9 * len(fuzzy)
    assert len(pairs) <= 4 * len(found)  # not all pairs of a group
    assert all(r.n_equal >= 0.8 * r.n_columns and r.end_word - r.start_word >= 50 and r.other_doc_id < r.doc_id for r in pairs)


def test_passages_of_odd_rows(odd, none):
    got = substring_fuzzy.fuzzy_passages(odd)
    assert {(r.start_word, r.end_word) for r in got.collect()} == {(0, 360)}  # the repeated line, in its second document
    assert substring_fuzzy.fuzzy_passages(none).count() == 0


# --- near duplicates --------------------------------------------------------------


def shingles(text, size):
    words = bytes(b + 32 if 65 <= b <= 90 else b for b in (text or "").encode()).split()
    if not words:
        return frozenset()
    size = min(size, len(words))
    return frozenset(tuple(words[i : i + size]) for i in range(len(words) - size + 1))


def brute_components(rows, size, percent):
    sets, root = [shingles(t, size) for _, t in rows], list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            if a and sets[j] and 100 * len(a & sets[j]) >= percent * len(a | sets[j]):
                root[max(find(i), find(j))] = min(find(i), find(j))
    return [len(s) for s in sets], [find(i) for i in range(len(rows))]


def copies(seed=11, n=250):
    rng = random.Random(seed)
    base = [[f"w{rng.randint(0, 900)}" for _ in range(rng.randint(2, 120))] for _ in range(25)]
    rows = []
    for i in range(n):
        words = list(rng.choice(base))
        for _ in range(rng.choice([0, 0, 1, 1, 2, 4])):
            words[rng.randrange(len(words))] = f"z{rng.randint(0, 9)}"
        rows.append((i, " ".join(words).upper() if i % 7 == 0 else " ".join(words)))
    return [*rows, (n, None), (n + 1, ""), (n + 2, "one"), (n + 3, "ONE")]


@pytest.mark.parametrize(("size", "percent"), [(3, 85), (5, 80)])
def test_components_equal_brute_force(llm, size, percent):
    rows = copies()
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in near_duplicates(llm.createDataFrame(rows, "doc_id long, text string"), size, percent).collect()}
    n, roots = brute_components(rows, size, percent)
    assert [got[d] for d, _ in rows] == [(a, b, b == d) for (d, _), a, b in zip(rows, n, roots)]


def test_signature_estimates_are_unbiased():
    rng = np.random.default_rng(3)
    for share in (0.3, 0.8, 0.95):
        errors = []
        for _ in range(60):
            common, a, b = (rng.integers(0, 1 << 63, k, np.uint64) for k in (int(400 * share), int(200 * (1 - share)), int(200 * (1 - share))))
            one, two = np.unique(np.concatenate((common, a))), np.unique(np.concatenate((common, b)))
            sig = [np.frombuffer(near_dup.pack(near_dup.minima(s)), np.uint8) for s in (one, two)]
            true = len(np.intersect1d(one, two)) / len(np.union1d(one, two))
            errors.append(near_dup.estimate(sig[0], sig[1][None, :])[0] - true)
        assert abs(np.mean(errors)) < 0.03


def test_odd_rows_and_one_row_of_each_group(odd, none):
    out = near_duplicates(odd)
    assert out.count() == odd.count() and out.columns == ["doc_id", "n_shingles", "component_id", "kept"]
    kept = drop_near_duplicates(odd)
    assert kept.columns == odd.columns
    rows = kept.collect()
    texts = [r.text for r in rows if r.text and r.text.split()]
    assert len(texts) == len(set(texts)) == len({t for t in (r.text for r in odd.collect()) if t and t.split()})
    blank = [r for r in odd.collect() if not (r.text or "").strip(" \n\t")]
    assert len([r for r in rows if not (r.text or "").strip(" \n\t")]) == len(blank)
    assert near_duplicates(none).count() == 0 and drop_near_duplicates(none).count() == 0


def test_components_of_long_chains(llm):
    links = [(k, k + 1) for k in range(40)] + [(100, 101), (103, 101), (7, 7)]
    got = {r.node: r.root for r in connected_components(llm.createDataFrame(links, "a long, b long")).collect()}
    assert got == {**{k: 0 for k in range(41)}, 100: 100, 101: 100, 103: 100}


@pytest.mark.parametrize("group", [1024, 6])
def test_drifting_copies_are_joined_link_by_link(llm, monkeypatch, group):
    """Each text differs a little from the one before, so no leader is linked with all; also with groups cut into blocks."""
    monkeypatch.setattr(near_dup, "GROUP", group)
    rng = random.Random(21)
    rows = []
    for start in range(3):
        words = [f"w{start}x{rng.randint(0, 500)}" for _ in range(90)]
        for _ in range(30):
            rows.append((len(rows), " ".join(words)))
            at = rng.randrange(80)
            words[at : at + rng.choice([1, 2, 8])] = [f"z{rng.randint(0, 10**6)}" for _ in range(2)]
    rng.shuffle(rows)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in near_duplicates(llm.createDataFrame(rows, "doc_id long, text string"), 3, 85).collect()}
    n, roots = brute_components(sorted(rows), 3, 85)
    assert [got[d] for d in range(len(rows))] == list(zip(n, roots))
    assert 3 < len(set(roots)) < 60


def test_shared_counts_equal_intersections():
    rng = np.random.default_rng(5)
    sets = [np.unique(rng.integers(0, 300, k).astype(np.uint64)) for k in (1, 50, 200, 400, 3)]
    counts = near_dup.shared_counts(sets, columns=64)
    for i, a in enumerate(sets):
        for j, b in enumerate(sets):
            assert i == j or counts[i, j] == len(np.intersect1d(a, b))
