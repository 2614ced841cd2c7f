"""Periodic runs against a search of every period, Lyndon lengths against comparing suffixes."""

import hashlib
import random
import zlib

import numpy as np
from pyspark.sql import functions as F
from sparkseek.llm import periodic_runs, workload

from .helpers import EDGES, clashing, documents


def brute_lengths(words):
    out = []
    for i in range(len(words)):
        j = i + 1
        while j < len(words) and words[j:] > words[i:]:
            j += 1
        out.append(j - i)
    return out


def brute_runs(words):
    n, out = len(words), []
    for period in range(1, n // 4 + 1):
        at = 0
        while at + period < n:
            start = at
            while at + period < n and words[at] == words[at + period]:
                at += 1
            length = at - start + period
            if at > start and length >= max(6, 4 * period):
                own = words[start : start + length]
                if not any(own[k:] == own[:-k] for k in range(1, period)):
                    out.append((start, length, period))
            at += 1
    return sorted(out)


def planted(doc_id, text):
    words = (text or "").encode().split()
    h = zlib.crc32(str(doc_id).encode())
    if doc_id is not None and h % 10 == 0 and words:
        n, g = len(words), h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    return [word.decode() for word in words]


def expected(doc_id, words):
    runs = brute_runs(words)
    best = min(runs, key=lambda run: (-run[1], run[0], run[2])) if runs else (None, None, None)
    gone = {k for start, length, period in runs for k in range(start + period, start + length)}
    digest = lambda text: hashlib.sha256(text.encode()).hexdigest()
    return (
        doc_id, len(runs), *best, None if best[0] is None else 1000 * best[1] // best[2],
        digest("".join(f"{s},{n},{p}\n" for s, n, p in runs)), digest(" ".join(w for k, w in enumerate(words) if k not in gone)),
    )


def texts(n, seed):
    pick = random.Random(seed)
    for _ in range(n):
        words = [pick.choice("abcdefgh"[: pick.choice([1, 2, 3, 8])]) for _ in range(pick.randint(0, 90))]
        for _ in range(pick.randint(0, 3)):
            at, period = pick.randint(0, len(words)), pick.randint(1, 9)
            part = [pick.choice("abcß") for _ in range(period)]
            words[at:at] = (part * 9)[: pick.randint(3 * period, 6 * period)]
        yield words


def test_lyndon_lengths_and_runs():
    for words in texts(1500, 1):
        numbers = [ord(word) for word in words]
        assert periodic_runs.lyndon_lengths(numbers) == brute_lengths(numbers)
        assert periodic_runs.runs_of(np.array(numbers, dtype=np.int64)) == brute_runs(numbers)


def test_stretches_lose_no_run(spark):
    rows = [(k, random.Random(k).choice([" ", "\t", "\n  "]).join(words)) for k, words in enumerate(texts(600, 2))]
    got = {row.doc_id: row for row in periodic_runs.find_runs(documents(spark, rows)).collect()}
    for doc_id, text in rows:
        assert [tuple(run) for run in got[doc_id].runs] == brute_runs(text.split())
        assert got[doc_id].n_words == len(text.split())


def test_query(spark, tmp_path):
    rows = [(k, " ".join(words)) for k, words in enumerate(texts(300, 3))] + [(1000 + k, "  ".join(f"w{k}" for k in range(70))) for k in range(60)] + EDGES
    clashing(documents(spark, rows)).write.parquet(str(tmp_path / "documents.parquet"))
    got = workload.queries()["op12_periodic_runs"](spark, str(tmp_path))
    assert got.columns == ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
    assert {kind for name, kind in got.dtypes if not name.endswith("sha256")} - {"bigint"} == set()
    small = [(doc_id, text) for doc_id, text in rows if text is None or not text.startswith("w w w w w w w w w w w w w w w w w w w w")]
    want = sorted(map(repr, (expected(doc_id, planted(doc_id, text)) for doc_id, text in small)))
    long_one = (5, 1, 0, 50_000, 1, 50_000_000)
    got = [tuple(row) for row in got.collect()]
    assert any(row[:6] == long_one for row in got)
    assert sorted(repr(row) for row in got if row[:6] != long_one) == want
    none = periodic_runs.find_runs(documents(spark, []))
    assert none.count() == 0 and none.filter(F.size("runs") > 0).count() == 0
