"""The filter audit and the phrases against their SQL and brute force, the mixed model against a plain loop."""

import math
import re
import zlib
from collections import Counter
from itertools import permutations

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.llm.test_joins_and_rules import EDGES

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOW = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
LONG = "word " * 150 + " ".join(f"w{i}" for i in range(40_000))
#: (doc_id, text, lang) with nulls, repeated rows and ids, one text under many ids, and marks of all kinds.
ROWS = (
    [(i, t, "en") for i, t in enumerate(EDGES)]
    + [(100 + i, "Same text, again; and again: same text. " * 12, "de" if i % 3 else None) for i in range(40)]
    + [(140, "Same text, again; and again: same text. " * 12, "de")] * 3
    + [(None, "Same text, again; and again: same text. " * 12, "fr"), (None, None, None), (None, "x", ""), (200, None, "fr"), (201, "", "fr"), (202, "UPPER Case $ 5% of a|b", "en")]
    + [(300 + i, "To be or not to be\nthat is it. To be" + " or not" * i, "en") for i in range(40)]
    + [(400, LONG, "en"), (401, LONG, "es")]
)
LABELS = [(0, 1, 0), (101, 1, 1), (101, 0, None), (102, None, 1), (140, 1, 1), (None, 1, 1), (400, 1, 0), (999, 1, 1)]


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    at = tmp_path_factory.mktemp("tables")
    spark.createDataFrame(ROWS, "doc_id long, text string, lang string").withColumn("words", F.lit(1)).withColumn("n", F.lit("x")).withColumn("row", F.lit(2)).repartition(5).write.parquet(f"{at}/documents.parquet")
    spark.createDataFrame(LABELS, "doc_id long, quality int, toxic int").write.parquet(f"{at}/labels.parquet")
    return str(at)


def sql(folder, name, columns):
    from tremolo.llm.queries import ORACLE_SQL

    c = duckdb.connect()
    for t in ("documents", "labels"):
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet{'' if folder.startswith('/root') else '/*.parquet'}'")
    return sorted(c.sql(f"SELECT {', '.join(columns)} FROM ({ORACLE_SQL[name]})").fetchall())


@pytest.mark.parametrize("name", ["op11_filter_audit", "op12_collocations"])
def test_equal_to_sql(spark, tables, name):
    from tremolo.llm.queries import QUERIES

    for folder in (tables, "/root/testdata/sf0.001"):
        got = QUERIES[name](spark, folder)
        assert sorted(tuple(r) for r in got.collect()) == sql(folder, name, got.columns)


def test_audit_by_plain_loops(spark, tables):
    from tremolo.llm.filter_audit import audit

    docs, labels = spark.read.parquet(f"{tables}/documents.parquet"), spark.read.parquet(f"{tables}/labels.parquet")
    least = {}
    for i, t, _ in ROWS:
        if i is not None:
            least[t or ""] = min(least.get(t or "", i), i)
    good, toxic = ({i for i, *x in LABELS if i is not None and x[k] == 1} for k in (0, 1))
    want = Counter()
    for i, t, lang in ROWS:
        t, part = t or "", lang or ""
        w = WORD.findall(t)
        fails = {f for f, bad in zip("ABCDE", (len(w) < 100, 100 * len(set(w)) < 80 * len(w), 100 * len(re.findall("[A-Z]", t)) > 10 * len(t), bool(re.search(r"[#$%&*|]", t)), i is not None and least[t] < i)) if bad}
        for p in permutations("ABCDE"):
            for k, f in enumerate(p):
                early, own = fails & set(p[:k]), f in fails
                key = (part, "".join(p), k + 1)
                want[(*key, "kept")] += not early and not own
                want[(*key, "removed")] += not early and own
                want[(*key, "redundant")] += bool(early) and own
                want[(*key, "unique_fails")] += fails == {f}
                want[(*key, "good_lost")] += not early and own and i in good
                want[(*key, "toxic_lost")] += not early and own and i in toxic
    got = audit(docs, labels).collect()
    assert len(got) == 600 * len({lang or "" for _, _, lang in ROWS})
    for r in got:
        assert all(r[c] == want[(r.part, r.filter_order, r.step, c)] for c in ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost")), r
        f = r.filter_order[r.step - 1]
        assert r.shapley == sum(want[(r.part, "".join(p), p.index(f) + 1, "removed")] for p in permutations("ABCDE"))
    assert audit(docs.where("false"), labels).count() == 0 and audit(docs, labels.where("false")).agg(F.sum("good_lost")).first()[0] == 0


def test_phrases_whatever_the_sketch(spark, tables):
    from tremolo.llm.collocations import frequent_grams, mine

    docs = spark.read.parquet(f"{tables}/documents.parquet").unionByName(spark.read.parquet("/root/testdata/sf0.001/documents.parquet"), allowMissingColumns=True)
    for kind in ({"max_n": 5, "least": 20}, {"max_n": 2, "least": 10, "share": (50, 100), "top": 7}):
        want = sorted(tuple(r) for r in mine(docs, **kind, sketch_bits=0).collect())
        assert want
        for bits in (8, 26):  # eight bits are nearly all marked
            assert sorted(tuple(r) for r in mine(docs, **kind, sketch_bits=bits).collect()) == want
    assert mine(docs.where("false")).count() == 0 and mine(docs.withColumn("text", F.lit(None).cast("string"))).count() == 0
    many = frequent_grams(docs.where("lang = 'en'").withColumn("text", F.lit("a b. ")), 2, 1, 20).collect()
    rows = docs.where("lang = 'en'").count()
    assert {(r.phrase, r.f, r.words) for r in many} == {("a", rows, 1), ("b", rows, 1), ("a b", rows, 2), ("", 2 * rows, 1)}


def test_packed_hashes_come_back():
    from tremolo.llm import collocations as C

    rng = np.random.default_rng(3)
    keys = np.sort(rng.integers(0, 1 << 32, 5000, dtype=np.uint64))
    assert (np.cumsum(C._unpack(C._pack(np.diff(keys, prepend=np.uint64(0))), 5000)) == keys.astype(np.int64)).all()
    k, c = C._summed(np.array([5, 1, 5], np.uint64), np.array([1, 2, 3]))
    assert k.tolist() == [1, 5] and c.tolist() == [2, 4]


# Context mixing


def decisions(text, words, code):
    """(slots, gate, outcome, node's log odds) of each decision of a text, one after the other."""
    from tremolo.llm import _text as X

    place, many = {w: i for i, w in enumerate(words)}, code.words

    def slot(k, context, node):
        h = int(X.mix(np.array([context], np.uint64) + np.uint64((k + 1) << 56))[0]) >> 32
        x = (h + node * 0x9E3779B1) & 0xFFFFFFFF
        x ^= x >> 15
        return ((x * 0x85EBCA6B) & 0xFFFFFFFF) >> (32 - 16)

    def steps(symbol, contexts, gate, deepest):
        for d, at in enumerate(range(code.first[symbol], code.first[symbol + 1])):
            node = int(code.node[at])
            yield [slot(k, c, node) for k, c in enumerate(contexts)], gate + min(d, deepest), int(code.bit[at]), float(code.odds[at])

    hash_of = lambda b: int(X.hash_spans(X.running(np.frombuffer(b, np.uint8)), np.array([0]), np.array([len(b)]))[0])
    before = [0, 0]
    for w in WORD.findall((text or "").translate(LOW)):
        b = w.encode()
        yield from steps(place.get(w, many), before, 0, 15)
        if w not in place:
            for i, c in enumerate(b + b" "):
                last = sum(b[i - k] << 8 * (k - 1) for k in (1, 2, 3) if i >= k) + (1 << 32)
                yield from steps(many + 2 + c, [last, (hash_of(b[:i]) + 7) % (1 << 64)], 16 + 4 * min(i, 3), 3)
        before = [b[-1] + 1, hash_of(b)]
    yield from steps(many + 1, before, 0, 15)


def plain_score(text, model):
    from tremolo.llm import context_mixing as C

    move, total = np.zeros(4), 0.0
    all_of = list(decisions(text, model.words.to_pylist(), model.code))
    for a in range(0, len(all_of), C._BLOCK):
        step = np.zeros(4)
        for slots, gate, bit, odds in all_of[a : a + C._BLOCK]:
            x = np.array([*(model.tables[k][s] / C._UNIT for k, s in enumerate(slots)), odds, 0.3])
            p = 1 / (1 + math.exp(-min(max(x @ (model.weights[gate] + move), -30), 30)))
            total += math.log10(p if bit else 1 - p)
            step += (bit - p) * x
        move += C._RATE * step
    return total


def test_mixing_against_plain_loops(spark, tables):
    from tremolo.llm import context_mixing as C

    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").where(F.length("text") < 1500).select("doc_id", "text", F.lit(1).alias("row"), F.lit("y").alias("c"))
    docs = docs.unionByName(spark.createDataFrame([(7000 + i, t, 1, "z") for i, t in enumerate([*EDGES, "ab " * 800, "the zq9x " * 700])], docs.schema)).withColumn("held_out", F.crc32(F.col("doc_id").cast("string")) % 10 == 0)
    rows = [(r.doc_id, r.text, r.held_out) for r in docs.collect()]
    # Fewer frequent words than there are, so that words are spelled and joined too.
    words, C.WORDS = C.WORDS, 300
    try:
        learned = C.learn(docs.where("not held_out"), slot_bits=16)
    finally:
        C.WORDS = words
    counts = Counter()
    for _, t, held in rows:
        if not held:
            counts.update(WORD.findall((t or "").translate(LOW)) + [""])
    n, v = sum(counts.values()), len(counts)
    assert (learned.n, learned.distinct) == (n, v) and {r.word: r.c for r in learned.counts.collect()} == counts
    assert 0 < len(learned.frequent) <= 300
    got = {}
    for r in C.score(docs, learned).collect():
        got.setdefault(r.doc_id, []).append(r)
    assert sum(map(len, got.values())) == len(rows)
    for i, t, held in rows:
        tokens = WORD.findall((t or "").translate(LOW)) + [""]
        for r in got[i]:
            assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held, len(tokens), sum(counts[w] > 0 for w in tokens), n)
            assert r.base_score == pytest.approx(sum(math.log10((counts[w] + 0.1) / (n + 0.1 * (v + 1))) for w in tokens), rel=1e-9)
            size = len((t or "").encode())
            assert r.n_bytes == size and (r.bits_per_byte is None if not size else r.bits_per_byte == pytest.approx(-r.score * math.log2(10) / size))
    for i, t, _ in [r for r in rows if len(r[1] or "") < 2000][:6] + [r for r in rows if r[0] >= 7000 and len(r[1] or "") < 20_000]:
        assert got[i][0].score == pytest.approx(plain_score(t, learned.model), rel=2e-4, abs=1e-4), t
    # The slots' counts, but for the texts that the weights are fitted on.
    seen = np.zeros((2, 1 << 16, 2))
    sample = {r.text for r in docs.where(~F.col("held_out") & (F.octet_length(F.coalesce("text", F.lit(""))) <= C.SAMPLE_BYTES)).where(F.pmod(F.xxhash64(F.lit(13), F.coalesce("text", F.lit(""))), F.lit(1_000_003)) < min(C.SAMPLE / counts[""], 0.05) * 1_000_003).select("text").collect()}
    for _, t, held in rows:
        if not held and t not in sample:
            for slots, _, bit, _ in decisions(t, learned.model.words.to_pylist(), learned.model.code):
                for k, s in enumerate(slots):
                    seen[k, s, bit] += 1
    for k in range(2):
        assert (C.log_odds(seen[k].ravel()) == learned.model.tables[k]).all()


def test_code_gives_a_distribution():
    from tremolo.llm import context_mixing as C

    code = C.code_of(np.array([50, 30, 3, 3, 1]), 20, 10, np.bincount(np.frombuffer(b"some rare words", np.uint8), minlength=256))
    length = np.diff(code.first)
    for own in (length[:7], length[7:]):
        assert sum(2.0**-x for x in own) == pytest.approx(1)
    assert length[0] == length[:7].min() and code.words == 5
    assert C.huffman(np.array([9, 0]))[0].tolist() == [0, 1, 2]


def test_held_out_texts_and_no_training(spark):
    from tremolo.llm import context_mixing as C
    from tremolo.llm.queries import QUERIES

    rows = QUERIES["op13_context_mixing"](spark, "/root/testdata/sf0.01").collect()
    held = [r for r in rows if r.held_out]
    assert len(rows) == 1000 and all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 10 == 0) for r in rows)
    assert sum(r.score for r in held) > sum(r.base_score for r in held)
    docs = spark.createDataFrame([(1, "some Words"), (2, None), (None, ""), (1, "some Words")], "doc_id long, text string").withColumn("held_out", F.lit(True))
    got = C.score(docs, C.learn(docs.where("false"), slot_bits=16)).collect()
    assert sorted(r.n_tokens for r in got) == [1, 1, 3, 3] and all(r.n_known == r.train_tokens == 0 and r.base_score == 0 for r in got) and all(r.score < 0 for r in got)
    assert C.score(docs.where("false"), C.learn(docs, slot_bits=16)).count() == 0


def test_every_training_row_is_counted_in_the_slots(spark):
    from tremolo.llm import context_mixing as C

    # Short texts, so many that a fitting sample would take some of them.
    docs = spark.createDataFrame([(f"w{i}",) for i in range(3000)], "text string")
    learned = C.learn(docs, slot_bits=16)
    seen = np.zeros((2, 1 << 16, 2))
    for i in range(3000):
        for slots, _, bit, _ in decisions(f"w{i}", learned.model.words.to_pylist(), learned.model.code):
            for k, s in enumerate(slots):
                seen[k, s, bit] += 1
    for k in range(2):
        assert (C.log_odds(seen[k].ravel()) == learned.model.tables[k]).all()
    assert (learned.model.weights == C.start_weights()).all()


def test_long_texts_are_counted_and_scored_in_small_batches(spark, monkeypatch):
    from tremolo.llm import context_mixing as C

    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before, most = spark.conf.get(key), spark.sparkContext.accumulator(0)
    docs = spark.range(40, numPartitions=1).select(F.col("id").alias("doc_id"), F.lit(False).alias("held_out"), F.concat(F.lit("some words "), F.col("id").cast("string")).alias("text"))
    alone = {r.doc_id: r.score for r in C.score(docs, C.learn(docs, slot_bits=16)).collect()}
    monkeypatch.setattr(C, "BATCH_ROWS", 7)
    for name in ("_count_slots", "_score"):

        def counted(batches, *args, own=getattr(C, name), **named):
            def each():
                for b in batches:
                    most.add(int(b.num_rows > 7))
                    yield b

            yield from own(each(), *args, **named)

        monkeypatch.setattr(C, name, counted)
    assert {r.doc_id: r.score for r in C.score(docs, C.learn(docs, slot_bits=16)).collect()} == alone
    assert most.value == 0 and spark.conf.get(key) == before


def test_gates_that_differ_are_looked_up():
    from tremolo.llm import context_mixing as C
    import pyarrow as pa

    words = pa.array(["other", "words"], pa.large_string())
    code = C.code_of(np.array([5, 3]), 4, 3, np.bincount(np.frombuffer(b"some rare", np.uint8), minlength=256))
    rng = np.random.default_rng(5)
    model = C.Model(words, code, rng.integers(-40, 40, (2, 1 << 16)).astype(np.int8), rng.random((32, 4)).astype(np.float32), 16)
    texts = ["other words some rare", "", "words " * 900, "some rare " * 300]
    got = C.cost(model, next(C.Words(C.X.text_of(pa.array(texts)), words).parts()))
    assert got / math.log(10) == pytest.approx([plain_score(t, model) for t in texts], rel=2e-4, abs=1e-4)
