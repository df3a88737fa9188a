import random

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from plumbline.llm import op01_language_masks as op1
from plumbline.llm import op06_benchmark_leaks as op6
from plumbline.llm import op07_simhash as op7
from plumbline.llm import op09_linear_grouping as op9
from plumbline.llm.queries import oracle_sql, queries

from .fixtures import EN, FR, documents, frame, prose, texts
from .test_duplicates import brute_removed
from .test_near_copies import brute_components


def test_filter_returns_all_languages_of_a_gram():
    rng = np.random.default_rng(1)
    counts = {f"l{k}": {int(g): 5 for g in rng.integers(0, 2**32, 4000)} for k in range(10)}
    shared = {int(g): 5 for g in rng.integers(0, 2**32, 500)}
    for lang in ("l2", "l7"):
        counts[lang] |= shared
    model = op1.build({k: list(v) for k, v in counts.items()}, {k: 1 for k in counts})
    at = {name: i for i, name in enumerate(model.languages)}
    for lang, own in counts.items():
        assert ((model.masks(np.array(list(own), np.uint32))[:, 0] >> np.uint64(at[lang])) & np.uint64(1)).all()  # never a miss
    other = rng.integers(0, 2**32, 100_000).astype(np.uint32)
    rate = ((model.masks(other)[:, 0] >> np.uint64(at["l2"])) & np.uint64(1)).mean()
    assert rate <= 3 * model.false_positive[at["l2"]] + 1e-3


def test_popcounts_are_corrected_and_decide():
    model = op1.build({"a": op1.grams(["hello world again"])[0], "b": op1.grams(["bonjour monde encore"])[0]}, {"a": 2, "b": 1})
    lang, score, coverage = model.predict(["hello world", "Bonjour, MONDE!", None, "", "12 ..", "zzzzqqq", "é"])
    assert lang == ["a", "b", "und", "und", "und", "a", "a"]
    assert score[0] == pytest.approx(1) and coverage[1] == pytest.approx(1) and not score[2:].any()


def test_masks_of_many_languages_count_alike():
    counts = {f"l{k}": {int(g): 9 for g in op1.grams([f"word{chr(97 + k)} common"])[0]} for k in range(12)}
    model = op1.build({k: list(v) for k, v in counts.items()}, {})
    hits, n = model.popcounts(["wordc common", "wordd"])
    values, owner = op1.grams(["wordc common", "wordd"])
    for t in range(2):
        own = values[owner == t]
        assert n[t] == len(own)
        assert hits[t].tolist() == [int(np.isin(own, np.array(list(counts[x]), np.uint32)).sum()) for x in model.languages]


def test_identify_learns_and_keeps_columns(spark):
    rng = random.Random(4)
    rows = [(i, prose(rng, EN if i % 2 else FR, 80), "en" if i % 2 else "fr") for i in range(200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = op1.train(docs.filter("doc_id < 150"))
    out = op1.identify(frame(spark), model).collect()
    assert len(out) == len(documents()) and out[0]["fp"] == 1 and "gone" in out[0].asDict()
    by = {r["doc_id"]: r for r in out}
    assert [by[d]["lang_pred"] for d in (60, 61, 62, 63)] == ["und"] * 4
    assert by[65]["lang_pred"] == "en" and 0 <= by[65]["score"] <= 1
    held = op1.identify(docs.filter("doc_id >= 150"), model).collect()
    assert all(r["lang_pred"] == r["lang"] for r in held)
    assert op1.identify(frame(spark, []), model).count() == 0
    assert {r["lang_pred"] for r in op1.identify(docs, op1.train(docs.filter("false"))).collect()} == {"und"}


@pytest.mark.parametrize("rare", [1, 4, 40])
def test_a_language_with_few_documents(spark, rare):
    """Held-out accuracy stays high, also of the language that training saw little of; nothing it holds is left out."""
    rng = random.Random(rare)
    rows = [(i, prose(rng, EN, 120), "en") for i in range(400)] + [(1000 + i, prose(rng, FR, 120), "fr") for i in range(rare)]
    docs = spark.createDataFrame(rows + [(None, *rows[0][1:])] * 3, "doc_id long, text string, lang string")
    model = op1.train(docs)
    fr = model.languages.index("fr")
    own = op1.grams([t for d, t, lang in rows if lang == "fr"])[0]
    assert model.languages == ["en", "fr"] and ((model.masks(np.unique(own))[:, 0] >> np.uint8(fr)) & 1).mean() > 0.9
    asked = [prose(rng, FR, 60) for _ in range(100)] + [prose(rng, EN, 60) for _ in range(100)]
    got = model.predict(asked)[0]
    right = [sum(g == "fr" for g in got[:100]), sum(g == "en" for g in got[100:])]
    assert right[1] >= 98 and right[0] >= (80 if rare == 1 else 98), right


def test_the_filter_grows_with_what_it_holds():
    rng = np.random.default_rng(5)
    for n in (100, 50_000, 700_000):
        model = op1.build({"a": np.unique(rng.integers(0, 2**32, n, dtype=np.uint32)), "b": np.zeros(0, np.uint32)}, {})
        assert model.false_positive[0] <= op1.MISTAKEN * 1.05 and model.false_positive[1] == 0
        assert (model.masks(rng.integers(0, 2**32, 200_000, dtype=np.uint32))[:, 0] & 1).mean() <= 2 * op1.MISTAKEN


def test_training_ignores_held_out_documents(spark):
    import zlib

    docs = spark.createDataFrame([(i,) for i in range(50)] + [(None,)], "doc_id long")
    got = {r[0]: r[1] for r in docs.select("doc_id", op1.held_out(docs["doc_id"])).collect()}
    assert got == {**{i: zlib.crc32(str(i).encode()) % 4 == 2 for i in range(50)}, None: False}


# benchmark


def items(n=40, seed=6):
    rng = random.Random(seed)
    return [(i, prose(rng, EN, rng.randint(6, 40)) + ". " + prose(rng, EN, rng.randint(3, 9)) + ".") for i in range(n)] + [(n, None), (n + 1, ""), (n + 2, "tiny item")]


def test_wand_retrieves_all_above_threshold():
    index = op6.build(items())
    rng = random.Random(8)
    vocabulary = list(index.terms.values())
    for threshold in (0.05, 0.2, 0.6):
        for _ in range(150):
            query = sorted(rng.sample(vocabulary, min(len(vocabulary), rng.randint(1, 60))))
            scores = np.zeros(len(index.entries))
            for t in query:
                scores[index.items[t]] += index.gains[t]
            got = op6.wand(index, query, threshold)
            assert [i for i, _ in got] == np.flatnonzero(scores >= threshold - 1e-9).tolist()
            assert np.allclose([s for _, s in got], scores[[i for i, _ in got]])


def test_blocks_skip_without_losing_items(monkeypatch):
    monkeypatch.setattr(op6, "BLOCK", 2)
    test_wand_retrieves_all_above_threshold()


def test_search_equals_scoring_every_passage():
    rows = items()
    index = op6.build(rows)
    rng = random.Random(10)
    sample = [prose(rng, EN, rng.randint(0, 400)) for _ in range(25)] + [None, ""]
    for k in range(0, 25, 3):
        sample[k] += " " + rows[k][1]
    pieces = [op6.words(t) for t in sample]
    got = {(t, e, p) for t, e, p, _ in op6.search(index, *op6.read(index, pieces))}
    want = set()
    for t, w in enumerate(pieces):
        for p in range(max(1, -(-len(w) // index.stride))):
            query = {index.terms[x] for x in w[p * index.stride : (p + 2) * index.stride] if x in index.terms}
            scores = np.zeros(len(index.entries))
            for q in query:
                scores[index.items[q]] += index.gains[q]
            want |= {(t, int(e), p) for e in np.flatnonzero(scores >= 1 - 1e-9)}
    assert got == want and len(want) >= 9


def brute_pairs(rows, bench):
    """Pairs that stand in some passage, by comparing every passage with every item."""
    out = set()

    def overlap(text, passage):
        w = op6.words(text)
        k = min(5, len(w))
        own = {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if w else set()
        return len(own & {tuple(passage[i : i + k]) for i in range(len(passage) - k + 1)}) / len(own) if own else 0

    for d, t in rows:
        w = op6.words(t)
        for i, item in bench:
            question, answer = op6.question_answer(item or "")
            stride = op6.STRIDE  # of the item alone, whatever else the benchmark holds
            while stride < len(op6.words(item)):
                stride *= 2
            for p in range(max(1, -(-len(w) // stride))):
                passage = w[p * stride : (p + 2) * stride]
                q = overlap(question, passage) >= 0.8 and (len(op6.words(question)) >= 5 or overlap(answer, passage) >= 0.8)
                if q or overlap(item or "", passage) >= 0.8:
                    out.add((d, i))
    return out


@pytest.mark.parametrize("shard", [4 << 20, 1500])
def test_leaks_are_found_and_clean_documents_left(spark, shard):
    rng = random.Random(11)
    bench = items()
    rows = [[i, prose(rng, EN, 300)] for i in range(40)]
    planted = {(k, k * 3 % 40) for k in range(0, 40, 5)}
    for d, i in planted:
        w = rows[d][1].split()
        rows[d][1] = " ".join(w[:100]) + " " + bench[i][1].upper() + " " + " ".join(w[100:])
    rows += [[None, bench[1][1]], [90, None], [91, ""]]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    table = spark.createDataFrame([(i, t, "extra") for i, t in bench], "item_id long, text string, score string")
    got = op6.retrieve(docs, table, shard).filter("contaminated").collect()
    assert {(r["doc_id"], r["item_id"]) for r in got} == planted | {(None, 1)} == brute_pairs(rows, bench)
    assert all(r["overlap"] == 1 and r["score"] == pytest.approx(1) for r in got)
    assert op6.retrieve(docs, table.filter("false")).count() == 0 and op6.retrieve(docs.filter("false"), table).count() == 0
    clean = op6.decontaminated(docs.withColumn("more", F.lit(1)), table, shard).collect()
    assert {r["doc_id"] for r in clean} == {d for d, _ in rows if d is not None} - {d for d, _ in planted} and clean[0]["more"] == 1
    assert op6.decontaminated(docs, table.filter("false")).count() == len(rows)


def leaks():
    """Items with short questions, short answers, or short altogether, and documents that hold them whole or in part."""
    rng = random.Random(13)
    bench = [(i, prose(rng, EN, rng.randint(6, 14)) + ". " + prose(rng, EN, rng.randint(12, 40)) + ".") for i in range(30)]
    bench += [(30, "why so. because " + prose(rng, EN, 9) + "."), (31, "who wasit then"), (32, "42"), (33, prose(rng, EN, 20) + ". yes."), (None, prose(rng, EN, 12)), (35, None), (36, " .. ")]
    rows = []
    for i, t in bench[:34]:
        question, answer = op6.question_answer(t)
        rows.append((100 + (i or 0), prose(rng, EN, 100) + " " + t.upper() + " " + prose(rng, EN, 150)))
        rows.append((200 + (i or 0), prose(rng, EN, 100) + " " + question + " " + prose(rng, EN, 150)))
        rows.append((300 + (i or 0), prose(rng, EN, 40) + " " + answer))
        w = question.split()  # halves far apart, a word that differs, an end cut off
        rows.append((400 + (i or 0), " ".join([*w[: len(w) // 2 + 4], prose(rng, EN, 200), *w[len(w) // 2 :]])))
        rows.append((500 + (i or 0), " ".join([*w[:-1], "other", prose(rng, EN, 20)])))
        w = t.split()
        rows.append((600 + (i or 0), " ".join([prose(rng, EN, 33), *w[: len(w) * 9 // 10]])))
    return bench, rows + [(40, "Why so?"), (41, "it is 421"), (42, None), (43, "4 2"), (None, "it is 42")]


@pytest.mark.parametrize("shard", [4 << 20, 700])
def test_questions_alone_and_short_items(spark, shard):
    bench, rows = leaks()
    want = brute_pairs(rows, [(i, t) for i, t in bench])
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    table = spark.createDataFrame(bench, "item_id long, text string")
    got = op6.retrieve(docs, table, shard).filter("contaminated").collect()
    assert {(r["doc_id"], r["item_id"]) for r in got} == want and len(got) == len(want)
    assert want >= {(100 + i, i) for i in range(34)} | {(200 + i, i) for i in range(30)} | {(131, 31), (None, 32)}
    assert not want & {(40, 30), (41, 32), (43, 32), (230, 30)}


def test_scores_do_not_depend_on_shards(spark):
    bench, rows = leaks()
    docs, table = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(bench, "item_id long, text string")
    one, many = (sorted((str(r["doc_id"]), str(r["item_id"]), round(r["score"], 9), r["passage"], r["overlap"]) for r in op6.retrieve(docs, table, n).collect()) for n in (4 << 20, 300))
    assert one == many and len(list(op6.shards(table, 300))) > 5


@pytest.mark.parametrize("shard", [4 << 20, 700])
def test_a_very_long_item_changes_no_other_pair(spark, shard):
    """Pieces of an item far apart are no match, and stay none when another item is long; the long item is found itself."""
    rng = random.Random(29)
    item = prose(rng, EN, 30)
    w = item.split()
    apart = " ".join(x for k in range(6) for x in (*w[4 * k : 4 * k + 9], prose(rng, FR, 600)))
    long = prose(rng, EN, 6000)
    rows = [(1, apart), (2, prose(rng, EN, 50) + " " + item), (3, prose(rng, FR, 90) + " " + long + " " + prose(rng, FR, 20)), (4, long[: len(long) // 2])]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(2)
    pairs = lambda bench: {(r["doc_id"], r["item_id"]) for r in op6.retrieve(docs, spark.createDataFrame(bench, "item_id long, text string"), shard).filter("contaminated").collect()}
    assert pairs([(1, item)]) == {(2, 1)} and pairs([(1, item), (2, long)]) == {(2, 1), (3, 2)}
    assert pairs([(1, item), (2, long)]) == brute_pairs(rows, [(1, item), (2, long)])


def test_repeated_items_and_one_scan(spark):
    """Many rows of one item are searched as one and all reported; the corpus is scanned once, whatever the shards."""
    bench, rows = leaks()
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    once = spark.createDataFrame(bench, "item_id long, text string")
    many = once.unionByName(spark.range(1000, 1300).select(F.col("id").alias("item_id"), F.lit(bench[3][1]).alias("text")))
    plain, repeated = ([tuple(r) for r in op6.retrieve(docs, t, 700, held=2000).collect()] for t in (once, many))
    assert len(repeated) == len(plain) + 300 * sum(r[1] == bench[3][0] for r in plain)
    assert set(plain) == {r for r in repeated if r[1] is None or r[1] < 1000}
    plan = op6.decontaminated(docs, many, 700)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("MapInArrow") == 1


def test_question_and_answer():
    assert op6.question_answer("One two. Three four? Five.") == ("One two. Three four?", " Five.")
    assert op6.question_answer("Only one sentence") == ("Only one sentence", "")
    assert op6.question_answer("First. then no stop") == ("First.", " then no stop")


def test_more_languages_than_bits_of_a_word():
    rng = random.Random(3)
    letters = "abcdefghijklmnopqrstuvwxyz"
    syllables = {f"l{k:03d}": ["".join(rng.choice(letters) for _ in range(3)) for _ in range(12)] for k in range(150)}
    write = lambda k, n: prose(rng, syllables[k], n)
    counts = {}
    for k in syllables:
        values, _ = op1.grams([write(k, 800)])
        counts[k] = {int(v): 5 for v in values}
    model = op1.build({k: list(v) for k, v in counts.items()}, {k: 9 for k in counts})
    assert model.table.shape[1] == 3
    names, score, coverage = model.predict([write(k, 60) for k in syllables] + ["12", "A. De"])
    assert sum(a == b for a, b in zip(names, syllables)) >= 148 and names[-2] == "und" and coverage[-1] == 1 and coverage[-2] == 0


# the pipeline


def test_stages_against_brute_force(spark, tmp_path):
    rng = random.Random(12)
    bench = items(8)
    rows = [(d, t, lang, s, n) for d, t, lang, s, n, *_ in documents() if d is not None]
    rows = list(dict.fromkeys(rows))
    rows.append((70, prose(rng, EN, 120) + " " + bench[2][1], "en", "src1", 10))
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(bench, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    d = str(tmp_path)
    stage = dict(corpus_pipeline.STAGES)
    a = stage["language_id"](spark, docs, d).persist()
    texts_a = {r["doc_id"]: r["text"] for r in a.collect()}
    assert not {60, 61, 62, 63} & set(texts_a) and set(range(60)) <= set(texts_a)
    b = stage["simhash_near_dedup"](spark, a, d).persist()
    label, _ = brute_components(texts_a)
    texts_b = {r["doc_id"]: r["text"] for r in b.collect()}
    assert set(texts_b) == set(label.values()) and not {30, 31} & set(texts_b)
    c = stage["suffix_array_dedup"](spark, b, d).persist()
    mask = brute_removed(texts_b)
    texts_c = {r["doc_id"]: r["text"] for r in c.collect()}
    assert texts_c == {i: np.frombuffer(t.encode(), np.uint8)[~mask[i]].tobytes().decode("utf-8", "ignore") for i, t in texts_b.items()}
    e = stage["decontamination"](spark, c, d).persist()
    assert set(texts_c) - {r["doc_id"] for r in e.collect()} == {70}
    assert a.columns == b.columns == c.columns == e.columns == docs.columns
    packed = stage["best_fit_packing"](spark, e, d)
    out = corpus_pipeline.run(spark, d)
    key = lambda df: sorted((r["doc_id"], r["piece"], r["length"], r["ids_crc32"]) for r in df.collect())
    assert key(out) == key(packed) and out.count() == packed.count()
    assert 4 <= len(corpus_pipeline.STAGES) <= 5 and corpus_pipeline.ORACLE_SQL is None


def test_stages_with_null_and_repeated_ids(spark, tmp_path):
    rng = random.Random(19)
    bench = items(5)
    a, b, c = (prose(rng, EN, 90) for _ in range(3))
    rows = [(None, a), (None, b), (None, a), (7, c), (7, prose(rng, EN, 70)), (None, prose(rng, EN, 60) + " " + bench[1][1]), (None, None), (8, b + " " + prose(rng, EN, 80))]
    rows += [(20 + k, prose(rng, FR if k % 2 else EN, 80)) for k in range(20)]
    docs = spark.createDataFrame([(d, t, "en" if k % 2 else "fr", None, 3) for k, (d, t) in enumerate(rows)], "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(bench, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    left = corpus_pipeline.decontaminate(spark, docs, str(tmp_path)).collect()
    assert len(left) == len(rows) - 1 and not any(bench[1][1] in (r["text"] or "") for r in left)
    near = corpus_pipeline.near_dedup(spark, docs, str(tmp_path))
    assert sorted(str(r["text"]) for r in near.collect()) == sorted({str(t) for _, t in rows})
    cleaned = {(r["doc_id"], len(r["text"] or "")) for r in corpus_pipeline.passage_dedup(spark, near, str(tmp_path)).collect()}
    assert {(None, len(a)), (None, len(b)), (7, len(c))} <= cleaned and not any(d == 8 and n > 600 for d, n in cleaned)
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == len({t for _, t in rows if t}) - 1


def test_every_operator_is_registered():
    names = list(queries())
    assert [n.split("_")[0] for n in names] == [f"op{k}" for k in range(1, 14)]
    assert set(oracle_sql()) <= set(names)
    assert op7.DISTANCE == 4 and op9.CAPACITY == 4096 and texts()[61] == ""
