"""Line dedup as op1 runs it: its cut against brute force, and its recall of repeated runs of lines."""

import hashlib

import xxhash
from pyspark.sql import functions as F

from sparkseek.llm import line_dedup, workload

from .helpers import documents

FOLDER = "/root/testdata/sf0.01"


def cut(lines, rule):
    start, chunks, rolled = 0, [], 0
    hashes = [xxhash.xxh64(line.encode(), seed=42).intdigest() for line in lines]
    for end in range(len(lines)):
        rolled = hashes[end]
        for back in range(1, min(rule.rolling, end + 1)):
            rolled ^= (hashes[end - back] << back | hashes[end - back] >> 64 - back) & (1 << 64) - 1
        ends = rolled & rule.mask == rule.value
        if end == len(lines) - 1 or (ends and end - start >= 1 and end < len(lines) - 2):
            chunks.append((start, tuple(lines[start : end + 1])))
            start = end + 1
    return chunks


def brute(rows):
    """Of each document the removed lines (numbers)."""
    first, removed = {}, {}
    for doc_id, text in sorted(rows):
        gone = removed[doc_id] = set()
        lines = (text or "").split("\n")
        for start, chunk in sorted({one for rule in line_dedup.FINE for one in cut(lines, rule)}):
            if len(chunk) > 1 and any(line.strip() for line in chunk):
                doc, at = first.setdefault(chunk, (doc_id, start))
                if doc != doc_id or start >= at + len(chunk):
                    gone.update(range(start, start + len(chunk)))
    return removed


def test_fine_cut_against_brute_force(spark):
    block = [f"common {k}" for k in range(40)]
    rows = [(k, "\n".join([f"own {k}", *block[k : k + 3 + k % 9], *["same"] * (k % 6), *block[: k % 5]])) for k in range(30)]
    rows += [(100, None), (101, ""), (102, "a"), (103, "a\nb"), (104, "a\nb"), (105, "a\nb\nc"), (106, "a\nb\nc"), (107, "\n" * 9), (108, "\n" * 9)]
    rows += [(200, "x\n" * 30_000), (201, "x\n" * 30_000)]
    found = {row.doc_id: row for row in line_dedup.remove_repeated(documents(spark, rows), cut=line_dedup.FINE).collect()}
    for doc_id, gone in brute(rows).items():
        lines = (dict(rows)[doc_id] or "").split("\n")
        left = "\n".join(line for k, line in enumerate(lines) if k not in gone)
        assert (found[doc_id].deduplicated, found[doc_id].n_removed) == (left, len(gone))
    assert [found[k].n_removed for k in (104, 106)] == [2, 3]


def test_chunks_are_compared_by_bytes_where_line_hashes_collide(spark, monkeypatch):
    """With every line hash, or none, taken for one that several lines share, the rows are the same."""
    block = [f"common {k}" for k in range(12)]
    rows = [(k, "\n".join([f"own {k}", *block[k % 4 : 5 + k % 7], *block[: k % 5]])) for k in range(20)]
    rows += [(50, "x\n" * 40), (51, "x\n" * 41), (52, None), (None, "\n".join(block)), (53, "a\nb"), (53, "a\nb")]

    def found():
        return sorted((row.doc_id or -1, row.n_removed, row.deduplicated) for row in line_dedup.remove_repeated(documents(spark, rows), cut=line_dedup.FINE).collect())

    plain = found()
    lines = F.explode(F.split(F.coalesce("own.text", F.lit("")), "\n"))
    monkeypatch.setattr(line_dedup, "_line_collisions", lambda rows: rows.select(lines.alias("one")).select(F.xxhash64("one").alias("line")).distinct())
    assert found() == plain and sum(removed for _, removed, _ in plain) > 50


def test_line_hashes_of_several_lines(spark):
    rows = line_dedup.with_rows(documents(spark, [(0, "a\nb\na"), (1, "a"), (2, None), (3, "b\na")]))
    assert line_dedup._line_collisions(rows).count() == 0


def test_recall_of_repeated_runs(spark):
    texts = {row.doc_id: (row.text or "").split("\n") for row in spark.read.parquet(f"{FOLDER}/documents.parquet").collect()}
    removed = brute([(doc_id, "\n".join(lines)) for doc_id, lines in texts.items()])
    for row in workload.queries()["op1_line_dedup"](spark, FOLDER).collect():
        left = "\n".join(line for k, line in enumerate(texts[row.doc_id]) if k not in removed[row.doc_id])
        assert (row.n_removed, row.kept_sha256) == (len(removed[row.doc_id]), hashlib.sha256(left.encode()).hexdigest())
    # Lines in runs of two or more adjacent lines, none blank, that an earlier document holds; those of runs of four and more; exact copies.
    seen, whole, repeated, hit, longer, hit_longer = set(), set(), 0, 0, 0, 0
    for doc_id, lines in sorted(texts.items()):
        pairs = {k: (lines[k], lines[k + 1]) for k in range(len(lines) - 1) if lines[k].strip() and lines[k + 1].strip()}
        runs = {place for k, pair in pairs.items() if pair in seen for place in (k, k + 1)}
        repeated, hit = repeated + len(runs), hit + len(runs & removed[doc_id])
        long = {k for k in runs if any(set(range(at, at + 4)) <= runs for at in range(k - 3, k + 1))}
        longer, hit_longer = longer + len(long), hit_longer + len(long & removed[doc_id])
        seen.update(pairs.values())
        if len(lines) > 1 and any(line.strip() for line in lines):
            assert tuple(lines) not in whole or len(removed[doc_id]) == len(lines)
            whole.add(tuple(lines))
    print(f"recall {hit} of {repeated}, of runs of four lines and more {hit_longer} of {longer}")
    assert hit > 0.85 * repeated and hit_longer > 0.9 * longer
    # No line is lost.
    assert {line for doc_id, lines in texts.items() for k, line in enumerate(lines) if k not in removed[doc_id]} == {line for lines in texts.values() for line in lines}
