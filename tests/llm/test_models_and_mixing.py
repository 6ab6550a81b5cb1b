import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.llm.test_joins_and_rules import EDGES, WORD, docs

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def corpus(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


def test_language_id(spark, corpus):
    from tremolo.llm.language_id import identify, learn
    from tremolo.llm.queries import language_fold

    rows = corpus.withColumn("held_out", language_fold())
    model = learn(rows.where("not held_out"))
    got = identify(rows, model).join(corpus.select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert np.mean([r.lang_pred == r.lang for r in got]) > 0.97 and all(0 <= r.score <= 1 for r in got)
    edge = {r.doc_id: r for r in identify(docs(spark, EDGES + ["123 ...", "²"]).withColumn("held_out", F.lit(True)), model).collect()}
    assert all(edge[i].lang_pred == "und" for i in (0, 1, 2, len(EDGES), len(EDGES) + 1)) and edge[9].lang_pred != "und"
    nothing = learn(rows.where("false"))
    assert {r.lang_pred for r in identify(rows.limit(3), nothing).collect()} == {"und"}


def test_quality_scores(spark, corpus):
    from tremolo.llm._sample import labelled
    from tremolo.llm.quality_nbsvm import fit, score
    from tremolo.llm.queries import quality_fold

    labels = spark.read.parquet(f"{SF}/labels.parquet")
    rows = labelled(corpus, labels, "quality", 3000, where=~quality_fold())
    assert not {r[0] for r in rows} & {r.doc_id for r in corpus.where(quality_fold()).select("doc_id").collect()}
    model = fit([r[1:] for r in rows])
    got = score(corpus.withColumn("held_out", quality_fold()), model).join(labels, "doc_id").where("held_out").collect()
    assert np.mean([r.predicted == r.quality for r in got]) > 0.93
    assert all(r.predicted == int(r.score >= 0.7) for r in got)
    edge = score(docs(spark, EDGES).withColumn("held_out", F.lit(False)), model).collect()
    assert len(edge) == len(EDGES) and all(0 <= r.score <= 1 for r in edge)
    assert fit([]).score(np.array([], int)) == 0.5 and fit([("a", 1)]).score(np.array([], int)) > 0.99


def targets(sizes, most=3.0):
    weight = {s: (1, 2, 3)[k % 3] for k, s in enumerate(sorted(sizes, key=lambda s: (s is None, s or "")))}
    left, open_, out = float(sum(sizes.values())), set(sizes), {}
    while open_:
        share = left / sum(weight[s] for s in open_)
        full = {s for s in open_ if share * weight[s] > most * sizes[s]}
        if not full:
            return out | {s: share * weight[s] for s in open_}
        for s in full:
            out[s] = most * sizes[s]
            left -= out[s]
        open_ -= full
    return out


def test_mixing(spark):
    from tremolo.llm.mixing import emit, mix

    rng = np.random.default_rng(2)
    texts = EDGES + ["w " * int(n) for n in rng.integers(1, 60, 900)]
    rows = [(i, t, None if i % 50 == 0 else "abcdefg"[min(int(rng.exponential(1.2)), 6)], "clash") for i, t in enumerate(texts)]
    d = spark.createDataFrame(rows, "doc_id long, text string, source string, target string")
    got = {r.doc_id: r for r in mix(d).collect()}
    again = {r.doc_id: (r.taken, r.shards) for r in mix(d.repartition(3)).collect()}
    sizes = {}
    for i, t, s, _ in rows:
        n = len(WORD.findall(t or ""))
        assert got[i].size == n and got[i].taken == n * got[i].copies <= 3 * n and len(got[i].shards) == got[i].copies
        assert again[i] == (got[i].taken, got[i].shards)
        sizes[s] = sizes.get(s, 0) + n
    want = targets(sizes)
    for s in sizes:
        own = [got[i] for i, _, x, _ in rows if x == s]
        assert all(r.source_size == sizes[s] and abs(r.target - want[s]) < 1e-6 * want[s] for r in own)
        assert abs(sum(r.taken for r in own) - want[s]) <= max(r.size for r in own)
    out = emit(mix(d, carry=True))
    assert out.columns == d.columns and out.count() == sum(r.copies for r in got.values())
    assert mix(d.where("doc_id < 0")).count() == 0


def test_splitting_tree(spark):
    from tremolo.llm.mixing import deal

    got = deal(spark.createDataFrame([("a", 40), ("b", 25), ("c", 0), (None, 7)], "source string, quota long"), 8).collect()
    by_shard, by_source = {}, {}
    for r in got:
        by_shard[r.shard] = by_shard.get(r.shard, 0) + r.quota
        by_source[r.source] = by_source.get(r.source, 0) + r.quota
    assert by_source == {"a": 40, "b": 25, None: 7} and sorted(by_shard) == list(range(8)) and set(by_shard.values()) == {9}


def test_preference_pairs(spark):
    from tremolo.llm.preference import preference_pairs, swapped_answers

    chosen = [(1, 0, "system", "s"), (1, 1, "user", "q"), (1, 2, "assistant", "good"), (2, 0, "user", "same"), (3, 0, "user", "only here"), (4, 0, None, None), (4, 1, "assistant", "<|end|>")]
    rejected = [(1, 0, "system", "s"), (1, 1, "user", "q"), (1, 2, "assistant", "bad"), (1, 3, "user", "more"), (2, 0, "user", "same"), (4, 0, None, None)]
    kind = "pair_id long, turn long, role string, text string"
    got = {r.pair_id: r for r in preference_pairs(spark.createDataFrame(chosen, kind), spark.createDataFrame(rejected, kind)).collect()}
    assert got[1].n_prompt == 2 and got[1].prompt == "<|system|>\ns<|end|>\n<|user|>\nq<|end|>\n" and got[1].chosen == "<|assistant|>\ngood<|end|>\n"
    assert [m.train for m in got[1].rejected_mask] == [True, False] and sum(m.n_chars for m in got[1].rejected_mask) == len(got[1].rejected)
    assert got[2].chosen == got[2].rejected == "" and got[3].n_prompt == 0 and got[3].rejected == ""
    assert got[4].n_prompt == 1 and "<|unknown|>" in got[4].prompt and got[4].chosen.count("<|end|>") == 1
    turns = spark.createDataFrame([(0, 0, "user", "q"), (0, 1, "assistant", "a0"), (0, 2, "user", "bye"), (1, 0, "user", "p"), (1, 1, "assistant", "a1"), (2, 0, "assistant", "alone"), (4, 0, "user", "no"), (5, 0, "assistant", None)], "conv_id long, turn long, role string, text string")
    pairs = {r.pair_id: r for r in preference_pairs(*swapped_answers(turns)).collect()}
    assert sorted(pairs) == [0, 1] and "a1" in pairs[0].rejected and "a0" in pairs[0].chosen and pairs[0].n_prompt == 1
    assert preference_pairs(*swapped_answers(turns.where("false"))).count() == 0


PIECES = pytest.importorskip("sentencepiece") and EDGES + ["Hello  world", " lead", "trail ", "▁ literal ▁▁", "日本語 text 🎉", "a" * 500, "tab\tnew\nline"]


def test_sampled_pieces(spark):
    from tremolo.llm.sampled_pieces import decode, sample_encodings, vocabulary, MODEL

    got = sample_encodings(docs(spark, PIECES), k=3).collect()
    same = {(r.doc_id, r.sample): r.ids for r in sample_encodings(docs(spark, PIECES).repartition(3), k=3).collect()}
    seen = {}
    for r in got:
        assert r.round_trip and decode(np.array(r.ids, int)).decode() == (PIECES[r.doc_id] or "") and same[r.doc_id, r.sample] == r.ids
        assert r.log_prob <= 1e-9 and r.log_inclusion <= 1e-9
        assert tuple(r.ids) not in seen.setdefault(r.doc_id, set())
        seen[r.doc_id].add(tuple(r.ids))
    assert set(seen) == set(range(len(PIECES))) and len(seen[0]) == 1 and len(seen[12]) == 3
    assert vocabulary(MODEL).longest == 16


def all_segmentations(v, text):
    """Every segmentation with its weight, by recursion over the pieces."""
    from sentencepiece import SentencePieceProcessor

    from tremolo.llm.sampled_pieces import MODEL

    sp = SentencePieceProcessor(model_file=MODEL)
    weight = dict(zip(v.ids.tolist(), v.log_prob.tolist()))

    def go(rest):
        if not rest:
            yield (), 0.0
        for n in range(1, len(rest) + 1):
            i = sp.piece_to_id(rest[:n])
            if i in weight and sp.id_to_piece(i) == rest[:n]:
                for tail, w in go(rest[n:]):
                    yield (i, *tail), w + weight[i]

    return dict(go("▁" + text.replace(" ", "▁")))


@pytest.mark.parametrize("text", ["then", "so it", "as  a", "wins"])
def test_sampling_follows_the_lattice(text):
    import pyarrow as pa

    from tremolo.llm import _text as X
    from tremolo.llm.sampled_pieces import MODEL, Lattices, sample_slice, vocabulary

    v, n = vocabulary(MODEL), 6000
    lattices = Lattices(v, 1.0)
    every = all_segmentations(v, text)
    total = np.logaddexp.reduce(list(every.values()))
    p = {k: float(np.exp(w - total)) for k, w in every.items()}
    got = sample_slice(v, lattices, X.text_of(pa.array([text] * n)), np.arange(n, dtype=np.uint64), 2)
    first, both = {}, {}
    for samples in got:
        first[tuple(samples[0][0].tolist())] = first.get(tuple(samples[0][0].tolist()), 0) + 1
        for ids, log_prob, _ in samples:
            both[tuple(ids.tolist())] = both.get(tuple(ids.tolist()), 0) + 1
            assert abs(np.exp(log_prob) - p[tuple(ids.tolist())]) < 1e-9
    for k, q in p.items():
        assert abs(first.get(k, 0) / n - q) < 5 * np.sqrt(q * (1 - q) / n) + 1e-3
        pair = q + sum(r * q / (1 - r) for j, r in p.items() if j != k and r < 1)
        assert abs(both.get(k, 0) / n - pair) < 5 * np.sqrt(pair * (1 - pair) / n + 1e-9) + 1e-3
    few = sample_slice(v, lattices, X.text_of(pa.array(["a"] * 5)), np.arange(5, dtype=np.uint64), 50)
    assert all(len(s) == len(all_segmentations(v, "a")) and all(x[2] == 0.0 for x in s) for s in few)


def test_kept_lattices_change_nothing(monkeypatch):
    import pyarrow as pa

    from tremolo.llm import _text as X, sampled_pieces as S

    v = S.vocabulary(S.MODEL)
    texts = [X.text_of(pa.array(x)) for x in (["some words here", "other words"], ["words again", "日本 some", "x" * 50], ["here they are, some words"])]
    keys = [np.arange(len(t), dtype=np.uint64) for t in texts]
    kept, got = S.Lattices(v, 1.0), []
    for limit in (10**6, 30):  # with the second limit the store begins again and again
        monkeypatch.setattr(S, "KEPT_NODES", limit)
        got += [[[(x.tolist(), y, z) for x, y, z in s] for s in S.sample_slice(v, kept, t, k, 3)] for t, k in zip(texts, keys)]
    alone = [[[(x.tolist(), y, z) for x, y, z in s] for s in S.sample_slice(v, S.Lattices(v, 1.0), t, k, 3)] for t, k in zip(texts, keys)]
    assert got == alone + alone


def test_pipeline(spark, tmp_path):
    import corpus_pipeline as cp

    d = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    columns, at = d.columns, d
    for name, stage in cp.STAGES:
        out = stage(spark, at, "/root/testdata/sf0.001")
        out.write.parquet(str(tmp_path / name))
        before, at = at, spark.read.parquet(str(tmp_path / name))
        if name == "mixture":
            assert set(at.select("doc_id").distinct().collect()) <= set(before.select("doc_id").collect())
        elif name != "pieces":
            assert at.count() <= before.count() and at.select("doc_id").distinct().count() == at.count()
        assert at.columns == columns or name == "pieces"
    assert at.count() > 0 and at.where("not round_trip").count() == 0


def test_units_are_added_to_kept_lattices_in_place():
    from tremolo.llm.sampled_pieces import MODEL, Lattices, sample_slice, vocabulary
    from tremolo.llm import _text as X
    import pyarrow as pa

    v, texts = vocabulary(MODEL), ["some words", "other words here", "some more of the words", "and the last"]
    keys = np.arange(len(texts)).astype(np.uint64)
    kept, columns = Lattices(v, 1.0), []
    t = X.text_of(pa.array([" ".join(f"word{i}" for i in range(300))], pa.large_string()))
    sample_slice(v, kept, t, keys[:1], 2)
    for i, x in enumerate(texts):
        t = X.text_of(pa.array([x], pa.large_string()))
        got, want = sample_slice(v, kept, t, keys[i : i + 1], 2)[0], sample_slice(v, Lattices(v, 1.0), t, keys[i : i + 1], 2)[0]
        assert [(a.tolist(), b, c) for a, b, c in got] == [(a.tolist(), b, c) for a, b, c in want]
        columns.append(kept.log_p)
    assert columns[1] is columns[2]  # not copied for each slice


def test_texts_of_a_slice_are_drawn_and_opened_together(monkeypatch):
    import pyarrow as pa

    from tremolo.llm import _text as X, sampled_pieces as S

    v, calls = S.vocabulary(S.MODEL), []
    own = S.uniforms
    monkeypatch.setattr(S, "uniforms", lambda key, counter: (calls.append(len(key) if np.ndim(key) else 1), own(key, counter))[1])
    texts = [f"the words of text {i} are here, 日本 too" for i in range(200)]
    keys = np.arange(200, dtype=np.uint64)
    got = S.sample_slice(v, S.Lattices(v, 1.0), X.text_of(pa.array(texts)), keys, 2)
    # One for each text's choice of an arc; what else is drawn, by array steps over many texts.
    assert sum(n > 1 for n in calls) < 100 and len(calls) < 400
    for i in (0, 63, 64, 199):
        alone = S.sample_slice(v, S.Lattices(v, 1.0), X.text_of(pa.array([texts[i]])), keys[i : i + 1], 2)[0]
        assert [(a.tolist(), b, c) for a, b, c in got[i]] == [(a.tolist(), b, c) for a, b, c in alone]
