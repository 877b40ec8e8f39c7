"""Odd rows, empty tables, clashing columns and brute force for the operators and for every stage of the pipeline."""

import itertools
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from fieldloom.llm import chat_template, cotraining, crf_langid, jaccard_join, packing, quality_rules, sentencepiece_codec, substring_dedup, topk, url_filter
from tests.llm.test_operators import ODD, SF, WORD, docs


def shingles(text, n):
    w = re.findall(WORD, "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    return {tuple(w[k : k + n]) for k in range(len(w) - n + 1)} if len(w) >= n else {tuple(w)} if w else set()


def components(texts, n, percent):
    """doc number -> smallest number reachable by links, by comparing all pairs."""
    sets, root = [shingles(t, n) for t in texts], list(range(len(texts)))
    links = [(a, b) for a, b in itertools.combinations(range(len(texts)), 2) if sets[a] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b])]
    moved = True
    while moved:
        moved = False
        for a, b in links:
            low = min(root[a], root[b])
            moved |= root[a] != root[b]
            root[a] = root[b] = low
    return root


def near_copies(n, seed=11, length=140):
    """Copies of one text with none to twelve edits, so that similarities lie on both sides of any threshold."""
    rnd = random.Random(seed)
    base = [f"w{rnd.randint(0, 10**6)}" for _ in range(length)]
    out = []
    for k in range(n):
        own = list(base)
        for _ in range(rnd.randint(0, 12)):
            own[rnd.randrange(length)] = f"z{rnd.randint(0, 30)}" if rnd.random() < 0.5 else f"u{k}x{rnd.random()}"
        out.append(" ".join(own))
    return out


def test_jaccard_of_500_near_copies(spark):
    texts = near_copies(500)
    got = {r.doc_id: r.component_id for r in jaccard_join.jaccard_components(docs(spark, texts), 4, 85).collect()}
    assert got == dict(enumerate(components(texts, 4, 85)))


def test_jaccard_of_a_group_without_a_centre(spark):
    texts = [t for t in near_copies(260, seed=5) if t.count("z") + t.count("u") > 3] + list(ODD)
    got = {r.doc_id: r.component_id for r in jaccard_join.jaccard_components(docs(spark, texts), 5, 80).collect()}
    assert got == dict(enumerate(components(texts, 5, 80)))


def test_jaccard_odd_ids(spark):
    rows = [(None, "a b c d e"), (7, "a b c d e"), (7, "a b c d e"), (7, "x y z u v"), (9, "x y z u v"), (4, None), (5, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("component_id", F.lit("clash"))
    got = Counter((r.doc_id, r.component_id) for r in jaccard_join.jaccard_components(df, 4, 85).collect())
    assert got == Counter([(None, 7), (7, 7), (7, 7), (7, 7), (9, 7), (4, 4), (5, 5)])
    assert jaccard_join.jaccard_components(df.filter("doc_id < 0"), 4, 85).count() == 0


def mahalanobis(x, support=0.75):
    """Squared distances by a plain regularised minimum covariance determinant with reweighting."""
    least = np.diag([v**2 for v in quality_rules.LEAST.values()])
    rng, best = np.random.default_rng(0), None
    h = int(np.ceil(support * len(x)))
    for start in range(12):
        rows = x if start == 0 else x[rng.choice(len(x), 12, replace=False)]
        mean, cov = rows.mean(0), np.cov(rows.T, bias=True) + least
        for _ in range(30):
            d = np.einsum("ij,jk,ik->i", x - mean, np.linalg.inv(cov), x - mean)
            rows = x[np.argsort(d, kind="stable")[:h]]
            mean, cov = rows.mean(0), np.cov(rows.T, bias=True) + least
        if best is None or np.linalg.slogdet(cov)[1] < best[0]:
            best = np.linalg.slogdet(cov)[1], mean, cov * quality_rules.CONSISTENT
    d = np.einsum("ij,jk,ik->i", x - best[1], np.linalg.inv(best[2]), x - best[1])
    rows = x[d <= quality_rules.REWEIGHT]
    mean, cov = rows.mean(0), np.cov(rows.T, bias=True) + least
    return np.einsum("ij,jk,ik->i", x - mean, np.linalg.inv(cov), x - mean)


def test_quality_rules_agree_with_plain_mcd(spark):
    rnd = random.Random(2)
    texts = []
    for k in range(700):
        words = [f"{rnd.choice('abcdefgh')}{rnd.randint(1, 10 ** rnd.randint(2, 7))}" for _ in range(rnd.randint(60, 140))]
        for _ in range(rnd.choice((0, 0, 0, 0, 1, 30)) if k % 3 == 0 else 0):
            words.insert(rnd.randrange(len(words)), rnd.choice("#$%"))
        if k % 12 == 0:
            words += words[: rnd.randint(10, 55)]
        if k % 25 == 0:
            words = [w * rnd.randint(1, 5) for w in words]
        texts.append("\n".join(" ".join(words[j : j + 9]) for j in range(0, len(words), 9)))
    rows = [(k, t, "en", "web") for k, t in enumerate(texts)]
    found = quality_rules.judge(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")).filter("not base_failed").orderBy("doc_id").collect()
    x = np.array([[r[f] for f in quality_rules.FEATURES] for r in found])
    want, got = mahalanobis(x), np.array([r.distance for r in found])
    assert np.median(np.abs(got / np.maximum(want, 1e-9) - 1)) < 0.05
    clear = np.abs(want / quality_rules.CUTOFF - 1) > 0.1
    assert ((got <= quality_rules.CUTOFF) == (want <= quality_rules.CUTOFF))[clear].all() and (want > quality_rules.CUTOFF).sum() >= 10


def test_quality_rules_odd_rows(spark):
    long = " ".join(f"w{k}" for k in range(60))
    rows = [(1, long, None, None), (1, long, None, None), (None, long, "en", None), (2, None, None, "s"), (3, "", "en", "s"), (4, long * 400, "en", "s")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").withColumns({"n_words": F.lit("mine"), "cell": F.lit(1)})
    got = quality_rules.judge(df).collect()
    assert len(got) == len(rows) and sum(r.base_failed for r in got) == 3
    assert quality_rules.base_statistics(df).columns.count("n_words") == 1 and "given_n_words" in quality_rules.base_statistics(df).columns


def plain_dedup(texts):
    """Every text without the runs of chunks that came before, by one dictionary over all of them."""
    seen, out = {}, []
    for doc, text in sorted(enumerate(texts)):
        raw = np.frombuffer((text or "").encode(), np.uint8)
        _, ends = substring_dedup.chunk_ends(raw, np.array([0, len(raw)]))
        spans, at = [], 0
        for end in ends.tolist():
            chunk = raw[at:end].tobytes()
            if seen.setdefault(chunk, (doc, at)) != (doc, at):
                spans.append({"start": at, "size": end - at})
            at = end
        out.append(substring_dedup._without(text, substring_dedup.runs(spans, substring_dedup.MIN_RUN)))
    return out


def test_substring_dedup_against_one_dictionary(spark):
    rnd = random.Random(21)
    phrase = "in the middle of the night and of the day"
    passage = " ".join(f"p{rnd.randint(0, 10**6)}" for _ in range(70))
    texts = [*ODD]
    for k in range(60):
        own = [f"o{rnd.randint(0, 10**7)}" for _ in range(rnd.randint(30, 200))]
        if k % 3 == 0:
            own.insert(len(own) // 2, phrase)
        if k % 10 == 0:
            own.insert(rnd.randrange(len(own)), passage)
        texts.append(" ".join(own))
    df = docs(spark, texts).withColumns({"span_id": F.lit("x"), "removed_spans": F.lit("y"), "_version": F.lit(1)})
    got = {r.doc_id: r.text for r in substring_dedup.deduplicate(df).collect()}
    assert got == dict(enumerate(plain_dedup(texts)))
    planted = [k + len(ODD) for k in range(60) if k % 10 == 0]
    assert sum(len(set(got[k].split()) & set(passage.split())) <= 35 for k in planted) == len(planted) - 1
    assert all(got[k] == texts[k] for k in range(len(ODD), len(texts)) if k not in planted)
    assert substring_dedup.deduplicate(df.filter("doc_id < 0")).count() == 0


def test_substring_dedup_null_and_repeated_ids(spark):
    passage = " ".join(f"t{k * 7919}" for k in range(90))
    rows = [(None, passage), (1, passage), (1, passage), (2, None), (2, f"other {passage}")]
    got = sorted(((r.doc_id, r.text) for r in substring_dedup.deduplicate(spark.createDataFrame(rows, "doc_id long, text string")).collect()), key=str)
    assert [t for k, t in got if k is None] == [passage]
    once = [t for k, t in got if k == 1]
    assert once[0] == once[1] and len(once[0]) < len(passage) / 2


def test_language_of_texts_without_letters_and_of_many_labels(spark):
    rows = [(k, " ".join(f"{chr(97 + k % 26)}{chr(97 + k // 26)}{c}o" for c in "abcdefgh") + "\nzz", f"l{k:03}") for k in range(90)]
    rows = [(k + 1000 * j, t, lang) for j in range(6) for k, t, lang in rows]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = crf_langid.fit(df)
    assert len(model.labels) == 90
    odd = spark.createDataFrame([(1, "½"), (2, "² ²"), (3, "Ⅷ 12 _"), (4, None), (5, ""), (6, "日本"), (None, "aao abo")], "doc_id long, text string").withColumn("score", F.lit("mine"))
    got = {r.doc_id: r for r in crf_langid.identify(odd, model).collect()}
    assert all((got[k].lang_pred, got[k].crf_score) == ("und", 0.0) for k in range(1, 6)) and got[6].lang_pred in model.labels and got[None].score == "mine"
    nothing = crf_langid.fit(df.filter("doc_id < 0"))
    assert {r.lang_pred for r in crf_langid.identify(odd, nothing).collect()} == {"und"} and crf_langid.identify(odd.filter("doc_id < 0"), model).count() == 0


def test_classifier_odd_rows(spark):
    d, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    model = cotraining.fit(d, labels)
    assert model.history and model.history == cotraining.fit(d.repartition(3), labels).history
    odd = docs(spark, ODD).withColumns({"p_text": F.lit("mine"), "kept": F.lit(1)})
    got = cotraining.classify(odd, model).collect()
    assert len(got) == len(ODD) and got[0].p_text == "mine" and all(0 <= r.cot_p_text <= 1 for r in got)
    assert cotraining.classify(odd.filter("doc_id < 0"), model).count() == 0
    one = cotraining.fit(d, labels.withColumn("quality", F.lit(1)))
    assert {r.quality_score for r in cotraining.classify(odd, one).collect()} == {1.0}


def test_co_training_learns_from_the_pool():
    rnd = np.random.default_rng(3)

    def rows(n, value):
        """The two views of a document agree; labelled rows know few of the features."""
        text = [([int(c)], [1.0]) for c in rnd.integers(0, 40, n) + 100 * value]
        meta = [([int(c)], [1.0]) for c in rnd.integers(0, 40, n) + 100 * value]
        return text, meta

    known, pool = [rows(8, v) for v in (0, 1)], [rows(200, v) for v in (0, 1)]
    text, meta = ([r for side in known for r in side[k]] for k in (0, 1))
    labels = np.repeat([0, 1], 8)
    free = [(t, m) for side in pool for t, m in zip(*side)]
    taken = set()

    def teach(fitted, platt):
        found = []
        for pupil in (0, 1):
            teacher = 1 - pupil
            score = np.array([fitted[teacher][0][r[teacher][0][0]] + fitted[teacher][1] for r in free])
            for value, order in ((1, np.argsort(-score)), (0, np.argsort(score))):
                fresh = [k for k in order if (pupil, k) not in taken][:20]
                taken.update((pupil, k) for k in fresh)
                found += [(pupil, value, *free[k]) for k in fresh]
        return found

    def accuracy(model):
        test = [rows(100, v) for v in (0, 1)]
        score = np.concatenate([[model.text[0][t[0][0]] + model.text[1] for t in side[0]] for side in test])
        return ((score > np.median(score)) == np.repeat([False, True], 100)).mean()

    assert accuracy(cotraining.co_train(text, meta, labels, teach, 3)) > accuracy(cotraining.co_train(text, meta, labels, lambda f, p: [], 3))


def test_chat_equal_turns_and_empty_table(spark):
    rows = [(1, None, "assistant", "b"), (1, 2, "assistant", "a"), (1, 2, "assistant", "a"), (1, 2, "user", None), (None, 1, "assistant", "<|im_end|>")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("formatted", F.lit("clash"))
    got = {r.conv_id: r for r in chat_template.conversation_digests(df).collect()}
    assert got[1].n_turns == 4 and got[1].loss_chars == 3 and got[None].loss_chars == len("<|im_end|>")
    assert chat_template.conversation_digests(df.filter("conv_id < 0")).count() == 0
    spanning = "{% generation %}{% for message in messages %}{{ '<|im_start|>' + message.role + '\\n' + message.text + '<|im_end|>\\n' }}{% endfor %}{% endgeneration %}"
    with pytest.raises(Exception, match="loss span|follows"):
        sink = chat_template.ReadBack()
        chat_template.Template(spanning).write([{"role": "user", "text": "x"}], sink)
        sink.write("<|im_start|>user\n<|im_end|>\n")


def test_url_rules_with_null_parts(spark):
    rules = [*url_filter.RULES, (None, "/", "block"), ("org", None, "block"), ("org", "/", None)]
    df = spark.createDataFrame([(1, "http://a.org/x"), (2, None)], "page_id long, url string")
    for limit in (100, 1):
        assert {r.verdict for r in url_filter.judge_urls(df, rules, max_broadcast_rules=limit).collect()} == {"allow"}
    assert url_filter.judge_urls(df.filter("page_id < 0"), rules).count() == 0


def test_sentencepiece_spark_rows(spark):
    import public_tokenizers

    path = public_tokenizers.path("piece_bpe_32k.model")
    df = spark.createDataFrame([(1, None), (1, None), (None, "a b"), (2, ""), (3, "é " * 50_000)], "doc_id long, text string").withColumn("n_tokens", F.lit("clash"))
    got = sentencepiece_codec.token_digests(df, path).collect()
    assert len(got) == 5 and [r.n_tokens for r in got if r.doc_id == 1] == [0, 0]
    assert sentencepiece_codec.token_digests(df.filter("doc_id < 0"), path).count() == 0 and sentencepiece_codec.encode_documents(df.filter("doc_id < 0"), path).count() == 0


def test_character_map_against_the_library():
    import sentencepiece

    rule = sentencepiece.SentencePieceNormalizer(rule_name="nmt_nfkc", add_dummy_prefix=False, remove_extra_whitespaces=False, escape_whitespaces=False)
    spec = dict(sentencepiece_codec._fields(dict(sentencepiece_codec._fields(rule.serialized_model_proto()))[3]))
    own = sentencepiece_codec.CharacterMap(spec[2])
    assert own.units
    rnd = random.Random(1)
    for _ in range(300):
        text = "".join(rnd.choice("abÅﬁ①Ⅷ½　ｶﾞé́\t日ｱ😀́ﷺ") for _ in range(rnd.randint(0, 12)))
        raw, at, out = text.encode(), 0, b""
        while at < len(raw):
            found = own.longest(raw, at)
            width = found[0] if found else 1 if raw[at] < 128 else 2 if raw[at] < 224 else 3 if raw[at] < 240 else 4
            out += found[1] if found else raw[at : at + width]
            at += width
        assert out.decode() == rule.normalize(text)


def test_topk_of_sparse_vectors(spark):
    rnd = np.random.default_rng(4)
    dense = np.where(rnd.random((200, 50)) < 0.1, rnd.integers(-4, 5, (200, 50)), 0) / 4
    rows = [(k, [float(v) for v in x][: 30 + k % 21]) for k, x in enumerate(dense)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = topk.exact_top_k(df.filter("vec_id % 20 = 0"), df, shard_rows=50, block_queries=4).collect()
    full = np.zeros((200, 50), np.int64)
    for k, v in rows:
        full[k, : len(v)] = np.floor(256 * np.array(v))
    for q in range(0, 200, 20):
        want = sorted((-int(full[q] @ full[j]), j) for j in range(200) if j != q)[:5]
        assert [(r.vec_id, r.score) for r in sorted((r for r in got if r.query_id == q), key=lambda r: r["rank"])] == [(j, -s) for s, j in want]


# --- the pipeline ---------------------------------------------------------------------------------


def test_pipeline_stages_on_odd_and_empty_tables(spark):
    pipeline = pytest.importorskip("corpus_pipeline")
    odd = docs(spark, [*ODD, *ODD]).withColumns({"lang_pred": F.lit("clash"), "kept": F.lit("clash"), "removed_spans": F.lit(1), "_n": F.lit(2)})
    for name, stage in pipeline.STAGES:
        out = stage(spark, odd, SF)
        assert (name == "packed") == (out.columns != list(pipeline.COLUMNS))
        assert out.count() <= 2 * len(ODD)
        assert stage(spark, odd.filter("doc_id < 0"), SF).count() == 0


def test_pipeline_near_duplicates_against_all_pairs(spark):
    pipeline = pytest.importorskip("corpus_pipeline")
    texts = near_copies(60, seed=3) + near_copies(40, seed=8) + [*ODD]
    root = components(texts, 5, 80)
    got = sorted(r.doc_id for r in pipeline.near_duplicates(spark, docs(spark, texts), SF).collect())
    assert got == sorted({root[k] for k in range(len(texts))})
    rows = [(1, "a b c d e f", "en", "x", 1), (1, "a b c d e f", "en", "a", 2), (1, "q r s t u v", "en", "x", 3), (None, None, None, None, None)]
    kept = pipeline.near_duplicates(spark, spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long"), SF).collect()
    assert sorted(tuple(r) for r in kept if r.doc_id) == [(1, "a b c d e f", "en", "a", 2), (1, "q r s t u v", "en", "x", 3)] and len(kept) == 3


def test_pipeline_filters_follow_their_operators(spark):
    pipeline = pytest.importorskip("corpus_pipeline")
    d = spark.read.parquet(f"{SF}/documents.parquet")
    model = crf_langid.fit(d)
    labeller = crf_langid.Labeller(model)
    rows = d.collect()
    want = {r.doc_id for r in rows for label, score in [tuple(x[0] for x in labeller.predict([r.text]))] if label != "und" and score >= pipeline.MIN_LANGUAGE_SCORE}
    assert {r.doc_id for r in pipeline.language(spark, d, SF).collect()} == want
    texts = {r.doc_id: r.text for r in rows}
    order = sorted(texts)
    got = {r.doc_id: r for r in pipeline.repeated_passages(spark, d, SF).collect()}
    assert [got[k].text for k in order] == plain_dedup([texts[k] for k in order])
    assert all(r.n_chars == (None if r.text is None else len(r.text)) for r in got.values())
    packed = pipeline.packed(spark, d, SF).collect()
    words = {k: len((t or "").split()) for k, t in texts.items()}
    assert sum(r.n_words for r in packed) == sum(words.values())
    free = {}
    for r in packed:
        free[r.bin_group, r.bin] = free.get((r.bin_group, r.bin), packing.CAPACITY) - r.n_words - 1
    assert min(free.values()) >= 0
