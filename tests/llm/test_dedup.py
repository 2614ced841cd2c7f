"""Exact, line, substring and near dedup against brute force."""

import hashlib
import re
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest
import xxhash

from sparkseek.llm import line_dedup, ngram_join, substring_dedup, words
from sparkseek.llm.components import components
from sparkseek.llm.exact_dedup import DigestIndex

from .helpers import EDGES, clashing, documents, shared_passages


def normalised(text):
    return re.sub(r"[\x20\x09-\x0D]+", " ", text or "")


def test_exact_groups(spark, tmp_path):
    rows = EDGES + [(7, "a  b\tc\nd"), (0, "a b c d ")]
    found = DigestIndex(spark, str(tmp_path)).add(documents(spark, rows)).collect()
    assert len(found) == len(rows)
    groups = defaultdict(list)
    for doc_id, text in rows:
        groups[hashlib.sha256(normalised(text).encode()).digest()].append(doc_id)
    for row in found:
        ids = groups[bytes(row.digest)]
        assert row.group_size == len(ids)
        assert row.keep_id == min((i for i in ids if i is not None), default=None)
        assert not row.kept or row.doc_id == row.keep_id
    assert sum(row.kept for row in found) == len(groups)


def test_exact_index_goes_on(spark, tmp_path):
    first = DigestIndex(spark, str(tmp_path), buckets=4)
    assert first.kept(documents(spark, [(5, "one"), (6, "two"), (7, "two")])).count() == 2
    again = DigestIndex(spark, str(tmp_path), buckets=64)  # a later session; the layout stays
    assert again.buckets == 4
    found = {row.doc_id: row for row in again.add(documents(spark, [(1, "two"), (2, "three"), (3, "three")])).collect()}
    assert (found[1].keep_id, found[1].kept) == (6, False)
    assert found[2].kept and not found[3].kept
    assert again.entries().count() == 3
    assert again.add(documents(spark, [])).count() == 0


def test_exact_batch_added_twice(spark, tmp_path):
    index = DigestIndex(spark, str(tmp_path), buckets=4)
    batch = documents(spark, [(1, "a"), (2, "b"), (3, "a"), (None, None)])
    assert sorted(row.doc_id or 0 for row in index.kept(batch).collect()) == [0, 1, 2]
    assert index.kept(batch).count() == 0
    again = index.add(batch).collect()
    assert not any(row.kept for row in again) and {row.doc_id: row.keep_id for row in again} == {1: 1, 2: 2, 3: 1, None: None}
    assert index.kept(documents(spark, [(1, "other"), (2, "b")])).count() == 1


def test_exact_anti_join_reads_buckets_in_place(spark, tmp_path):
    index = DigestIndex(spark, str(tmp_path), buckets=4)
    index.kept(documents(spark, [(1, "one")]))
    new = index.entries().select("digest").join(index.entries().hint("merge"), "digest", "left_anti")
    plan = new._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Exchange" not in plan


def test_exact_keeps_columns(spark, tmp_path):
    docs = clashing(documents(spark, EDGES))
    kept = DigestIndex(spark, str(tmp_path)).kept(docs)
    assert kept.columns == docs.columns
    assert kept.count() == len({normalised(text) for _, text in EDGES})


def rotated(value, by):
    return ((value << by) | (value >> (64 - by))) & (1 << 64) - 1


def brute_lines(rows):
    chunks = []
    for k, (doc_id, text) in enumerate(rows):
        lines = (text or "").split("\n")
        hashes = [xxhash.xxh64(line.encode(), seed=42).intdigest() for line in lines]
        start = 0
        for end in range(len(lines)):
            value = 0
            for back in range(line_dedup.ROLLING):
                if end >= back:
                    value ^= rotated(hashes[end - back], back)
            if end == len(lines) - 1 or value & line_dedup.MASK == 0:
                chunks.append((k, start, tuple(lines[start : end + 1])))
                start = end + 1
    seen, left, removed = set(), defaultdict(list), defaultdict(int)
    order = sorted(range(len(rows)), key=lambda k: (rows[k][0] is None, rows[k][0] or 0))
    for k, _, lines in sorted(chunks, key=lambda c: (order.index(c[0]), c[1])):
        if len(lines) > 1 and lines in seen and any(line.strip(" \r\t") for line in lines):
            removed[k] += len(lines)
        else:
            left[k] += lines
        seen.add(lines)
    return {rows[k][0]: ("\n".join(left[k]), len((rows[k][1] or "").split("\n")), removed[k]) for k in range(len(rows))}


def test_lines_against_brute_force(spark):
    block = "\n".join(f"common line {k}" for k in range(14))
    rows = [(k, f"own {k}\n{block}\nend {k % 3}\nmore {k % 3}\nlast\n\n\n") for k in range(40)]
    rows += [(100, None), (101, ""), (102, "\n\n\n\n\n\n\n\n"), (103, "\n\n\n\n\n\n\n\n"), (104, "x" * 100_000 + "\n" + block + "\n" + block), (None, block)]
    found = line_dedup.remove_repeated(documents(spark, rows)).collect()
    want = brute_lines(rows)
    assert {row.doc_id: (row.deduplicated, row.n_lines, row.n_removed) for row in found} == want
    assert sum(row.n_removed for row in found) > 200


def test_lines_equal_rows_and_columns(spark):
    text = "\n".join(f"line {k}" for k in range(30))
    docs = clashing(documents(spark, [(1, text)] * 4))
    found = line_dedup.remove_repeated(docs, n_lines="lines_")
    assert found.columns == [*docs.columns, "deduplicated", "lines_", "n_removed"]
    removed = sorted(row.n_removed for row in found.collect())
    assert removed[0] == 0 and removed[1] == removed[3] > 20
    assert line_dedup.remove_repeated(documents(spark, [])).count() == 0


def brute_passages(rows):
    words = [(doc_id, re.findall(r"[^\x20\x09-\x0D]+", text or "")) for doc_id, text in rows]
    owner = {}
    for doc_id, row in words:
        for s in range(len(row) - 12):
            if doc_id is not None:
                key = tuple(row[s : s + 13])
                owner[key] = min(owner.get(key, doc_id), doc_id)
    out = []
    for doc_id, row in words:
        gone = set()
        for s in range(len(row) - 12):
            if doc_id is not None and owner[tuple(row[s : s + 13])] < doc_id:
                gone.update(range(s, s + 13))
        out.append((doc_id, len(row), len(gone), " ".join(w for k, w in enumerate(row) if k not in gone)))
    return sorted(out, key=repr)


@pytest.mark.parametrize(("words", "block_bytes"), [(3, 300), (12, 2000), (40, 1 << 20)])
def test_passages_against_brute_force(spark, words, block_bytes):
    texts = shared_passages(150, words, words)
    rows = EDGES + [(10 + (k * 7) % 150, text) for k, text in enumerate(texts)] + [(200, texts[3]), (200, texts[3]), (-4, texts[5])]
    found = substring_dedup.remove_repeated(clashing(documents(spark, rows)), block_bytes=block_bytes).collect()
    assert sorted(map(tuple, found), key=repr) == brute_passages(rows)


def test_passages_sharded(spark, monkeypatch):
    monkeypatch.setattr(substring_dedup, "SHARD", 7)
    rows = list(enumerate(shared_passages(60, 5, 20)))
    found = substring_dedup.remove_repeated(documents(spark, rows)).collect()
    assert sorted(map(tuple, found), key=repr) == brute_passages(rows)
    assert substring_dedup.remove_repeated(documents(spark, [])).count() == 0


def shingles(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(words[k : k + 3]) for k in range(max(1, len(words) - 2))} if words else set()


def brute_links(rows):
    sets = [shingles(text) for _, text in rows]
    near = [[j for j in range(len(rows)) if j != i and None not in (rows[i][0], rows[j][0]) and sets[i] and 100 * len(sets[i] & sets[j]) >= 90 * len(sets[i] | sets[j])] for i in range(len(rows))]
    out = []
    for i, (doc_id, _) in enumerate(rows):
        reach, todo = {i}, [i]
        while todo:
            for j in near[todo.pop()]:
                if j not in reach:
                    reach.add(j)
                    todo.append(j)
        out.append((doc_id, len(sets[i]), None if doc_id is None else min(rows[j][0] for j in reach), len(near[i])))
    return sorted(out, key=repr)


def near_copies(n, seed):
    import random

    pick = random.Random(seed)
    base = [f"w{pick.randrange(40)}" for _ in range(120)]
    texts = []
    for k in range(n):
        row = [f"v{pick.randrange(400)}" for _ in range(30)] if k % 5 == 4 else list(base)
        for _ in range(pick.randint(0, 6)):
            row[pick.randrange(len(row))] = f"x{pick.randrange(5000)}"
        texts.append(" ".join(row))
    return texts


@pytest.mark.parametrize(("block_bytes", "chunk"), [(4000, 8), (1 << 20, 512)])
def test_links_against_brute_force(spark, block_bytes, chunk):
    texts = near_copies(120, 3) + near_copies(40, 4) + shared_passages(80, 9, 30)
    rows = EDGES + [(10 + (k * 11) % 240, text) for k, text in enumerate(texts)] + [(300, texts[0].upper()), (300, texts[0]), (301, "a b"), (302, "A  B"), (303, "a")]
    found = ngram_join.link_documents(clashing(documents(spark, rows)), block_bytes=block_bytes, chunk=chunk)
    got = sorted(map(tuple, found.select("doc_id", "n_shingles", "component_id", "n_links").collect()), key=repr)
    assert got == brute_links(rows)


def test_links_keep_one_of_each_class(spark):
    texts = near_copies(60, 8)
    rows = EDGES + [(10 + k, text) for k, text in enumerate(texts)]
    docs = clashing(documents(spark, rows))
    kept = ngram_join.kept(docs)
    assert kept.columns == docs.columns
    want = defaultdict(int)
    for doc_id, _, component, _ in brute_links(rows):
        if doc_id is not None and doc_id == component:
            want[doc_id] = max(want[doc_id], 1)
    nulls = sum(doc_id is None for doc_id, _ in rows)
    got = [row.doc_id for row in kept.select("doc_id").collect()]
    assert sorted(x for x in got if x is not None) == sorted(want)
    assert got.count(None) == nulls
    assert ngram_join.kept(documents(spark, [])).count() == 0


def test_components_of_a_path_and_a_star(spark):
    edges = [(k, k + 1) for k in range(50)] + [(1000, k) for k in range(900, 960)] + [(7, 7)]
    found = {row.node: row.root for row in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert {found[k] for k in range(51)} == {0}
    assert {found[k] for k in [*range(900, 960), 1000]} == {900}


def test_families_of_hashes_are_independent():
    """No function of one family's hash gives the other's: words that agree in the sums of one differ in those of the other."""
    found = words.Words([shared_passages(1, 3, words=200, length=5000)[0].encode()], families=2)
    one, two = (found.runs(13, family=k) for k in (0, 1))
    assert len(set(one.tolist())) == len(set(two.tolist()))
    # The old second hash was a scramble of the first one's sum; these sums have nothing in common.
    assert not np.isin(one, two).any()
    assert abs(np.corrcoef((one >> np.uint64(40)).astype(float), (two >> np.uint64(40)).astype(float))[0, 1]) < 0.1


def test_automata_remove_equal_words_only():
    text = " ".join(f"w{k}" for k in range(40))
    docs = pa.table({"doc_id": pa.array([5, 6, None, 1]), "text": pa.array([text, text.replace("w20", "W20"), text, text])})
    passages = pa.table({
        "owner": pa.array([3, 3, 2]), "block": pa.array([0, 0, 0]),
        "passage": pa.array([" ".join(f"w{k}" for k in range(10, 33)), " ".join("unrelated" for _ in range(20)), "too short"]),
    })
    found = substring_dedup._remove((pa.scalar(0),), docs, passages).to_pylist()
    gone = [sorted(set(text.split()) - set(row["kept"].split()), key=lambda word: int(word[1:])) for row in found]
    assert gone[0] == [f"w{k}" for k in range(10, 33)]
    assert found[1]["n_removed"] == 0 and found[2]["n_removed"] == 0 and found[3]["n_removed"] == 0


def test_passages_are_the_owners_words(spark):
    rows = [(k, text) for k, text in enumerate(shared_passages(120, 9))]
    dealt, passages = substring_dedup.recurring_passages(documents(spark, rows), block_bytes=700)
    texts = {doc_id: text.split() for doc_id, text in rows}
    first = {}
    for doc_id, own in texts.items():
        for k in range(len(own) - 12):
            first.setdefault(tuple(own[k : k + 13]), set()).add(doc_id)
    covered = set()
    for row in passages.collect():
        own = row.passage.split()
        for k in range(len(own) - 12):
            window = tuple(own[k : k + 13])
            assert min(first[window]) == row.owner and len(first[window]) > 1
            covered.add(window)
    assert covered == {window for window, ids in first.items() if len(ids) > 1}
