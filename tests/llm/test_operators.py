"""Training-data operators against brute force, exact round trips and held-out accuracy, with odd rows in every table."""

import itertools
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from fieldloom.llm import chat_template, cotraining, crf_langid, jaccard_join, packing, quality_rules, sentencepiece_codec, substring_dedup, topk, url_filter

SF = "/root/testdata/sf0.001"
WORD = r"[^\x20\x09-\x0D]+"
ODD = [None, "", " \n\t ", "one", "two words here", "x" * 3000, "é ß 日本 😀", "a b c d e f g"]


def docs(spark, texts, **more):
    rows = [(k, t, None if k % 5 == 0 else "en", None if k % 7 == 0 else "web", None if t is None else len(t), "clash") for k, t in enumerate(texts)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, score string")


def copies():
    rnd = random.Random(4)
    base = [[f"w{rnd.randint(0, 400)}" for _ in range(120)] for _ in range(6)]
    out = list(ODD) * 2
    for words in base:
        for edits in (0, 0, 1, 2, 4, 9, 30):
            own = list(words)
            for _ in range(edits):
                own[rnd.randrange(len(own))] = f"z{rnd.random()}"
            out.append(" ".join(own).upper() if edits == 1 else " ".join(own))
    return out


def test_topk(spark):
    rnd = np.random.default_rng(1)
    rows = [(k, [float(x) for x in rnd.integers(-3, 4, 6) / 8]) for k in range(300)] + [(300, None), (301, [1.0, None]), (302, [float("nan")]), (5, [9.0] * 6)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("score", F.lit("x"))
    got = topk.exact_top_k(df.filter("vec_id % 50 = 0"), df, shard_rows=64, block_queries=3)
    ok = [(k, np.floor(256 * np.array(v)).astype(int)) for k, v in rows[:300] + rows[303:]]
    for k, q in ((k, q) for k, q in ok if k % 50 == 0):
        want = sorted(((-int(q @ v), j) for j, v in ok if j != k))[:5]
        assert [(r.vec_id, r.score) for r in sorted(got.filter(F.col("query_id") == k).collect(), key=lambda r: r["rank"])] == [(j, -s) for s, j in want]
    assert topk.exact_top_k(df.filter("vec_id < 0"), df).count() == 0


def test_packing(spark):
    texts = copies() + ["w " * 900]
    got = packing.pack_documents(docs(spark, texts), capacity=200, group_rows=20).collect()
    words = {k: len((t or "").split()) for k, t in enumerate(texts)}
    assert {k: sum(r.n_words for r in got if r.doc_id == k) for k in words if words[k]} == {k: n for k, n in words.items() if n}
    for _, rows in itertools.groupby(sorted((r for r in got if r.bin_group >= 0), key=lambda r: (r.bin_group, r.bin)), key=lambda r: (r.bin_group, r.bin)):
        rows = list(rows)
        assert sum(r.n_words + 1 for r in rows) <= 200
        sources = [r.doc_id for r in rows if r.doc_id % 7]
        assert len(sources) <= 1  # all of them have one source
    assert packing.pack_documents(docs(spark, ["a"]).filter("doc_id < 0")).count() == 0


@pytest.mark.parametrize("group_rows", [3, 8192])
def test_packing_full_pieces_have_bins_of_their_own(spark, group_rows):
    texts = [f"w{k} " * n for k, n in enumerate([199, 398, 597, 1000, 5, 198, 200, 199 * 7])] + [f"w{3} " * 1000]
    got = packing.pack_documents(docs(spark, texts), capacity=200, group_rows=group_rows).collect()
    spans = Counter((r.doc_id, r.piece, r.start_word, r.n_words) for r in got)
    want = Counter((k, p, 199 * p, min(199, len(t.split()) - 199 * p)) for k, t in enumerate(texts) for p in range(-(-len(t.split()) // 199)))
    assert spans == want
    bins = {}
    for r in got:
        bins.setdefault((r.bin_group, r.bin), []).append(r)
    for (group, _), rows in bins.items():
        assert sum(r.n_words + 1 for r in rows) <= 200 and sorted(r.slot for r in rows) == list(range(len(rows)))
        assert len({texts[r.doc_id] for r in rows}) == len(rows)
        assert len([r for r in rows if r.doc_id % 7]) <= 1  # all of them have one source
        assert (group < 0) == (rows[0].n_words == 199)
    for group in {g for g, _ in bins if g < 0}:
        rows = sorted((r for r in got if r.bin_group == group), key=lambda r: r.bin)
        assert [r.bin for r in rows] == list(range(len(rows))) and rows == sorted(rows, key=lambda r: (r.doc_id, r.piece))


def test_packing_is_best_fit():
    rnd = np.random.default_rng(3)
    sizes, sources, clusters = np.sort(rnd.integers(1, 90, 300))[::-1], rnd.integers(-1, 40, 300), rnd.integers(-1, 60, 300)
    got = packing.pack(sizes, sources, clusters, 100)[0]
    bins = []
    for s, a, b, g in zip(sizes, sources, clusters, got):
        fits = [(x["free"], k) for k, x in enumerate(bins) if x["free"] >= s and (a < 0 or a not in x["a"]) and (b < 0 or b not in x["b"])]
        if fits:
            assert bins[g]["free"] == min(fits)[0]
        else:
            assert g == len(bins)
            bins.append({"free": 100, "a": set(), "b": set()})
        bins[g]["free"] -= s
        bins[g]["a"].add(a)
        bins[g]["b"].add(b)


def test_quality_rules(spark):
    texts = copies() + ["a b c a b c d\n\n x \n x \n#$ y"] + [" ".join(f"w{k}x{j}" for j in range(60)) for k in range(150)] + ["# $ % " * 40 + " ".join(f"u{j}" for j in range(200))]
    found = quality_rules.judge(docs(spark, texts))
    assert "Python" not in found._jdf.queryExecution().executedPlan().toString()
    got = {r.doc_id: r for r in found.collect()}
    for k, t in enumerate(texts):
        words, lines = re.findall(WORD, t or ""), [x for x in (t or "").split("\n") if re.search(WORD, x)]
        grams = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
        many = Counter(grams)
        repeats = len({i + j for i, g in enumerate(grams) if many[g] > 1 for j in range(3)})
        want = (len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in t or ""), len(lines) - len(set(lines)), repeats)
        assert tuple(got[k][c] for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")) == want
        assert got[k].base_failed == (len(words) < 50 or 100 * repeats > 50 * len(words))
    assert quality_rules.judge(docs(spark, ["a"]).filter("doc_id < 0")).count() == 0


def test_quality_rules_reject_repeats_and_keep_clean(spark):
    rnd = random.Random(6)
    prose = lambda n: [f"{k}{'abcdefgh'[: rnd.randint(3, 8)]}" for k in rnd.sample(range(100, 1000), n)]
    clean = ["\n".join(" ".join(prose(12)) for _ in range(10)) for _ in range(300)]
    # one short line again and again between long ones: no three words are repeated
    lines = ["\n".join(f"{' '.join(prose(12))}\nmore" for _ in range(k)) for k in range(5, 12)]
    words = [" ".join(x + x[:n]) for n in (20, 24, 28) for x in [prose(100)]]
    rows = [(k, t, "en", "web") for k, t in enumerate(clean + lines + words)]
    got = {r.doc_id: r for r in quality_rules.judge(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")).collect()}
    assert not any(r.base_failed for r in got.values())
    assert sum(got[k].kept for k in range(300)) >= 297
    assert not any(got[k].kept for k in range(300, len(rows)))


def test_classifier(spark):
    d, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    fold = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 0
    model = cotraining.fit(d, labels.filter(~fold))
    rows = cotraining.classify(d, model).join(labels.filter(fold), "doc_id").select("kept", "quality").collect()
    assert np.mean([r.kept == (r.quality == 1) for r in rows]) >= 0.85
    assert cotraining.classify(docs(spark, ODD), model).filter("quality_score between 0 and 1").count() == len(ODD)
    nothing = cotraining.fit(d, labels.filter("doc_id < 0"))
    assert {r.quality_score for r in cotraining.classify(docs(spark, ODD), nothing).collect()} == {0.5}


def test_chat_round_trip(spark):
    texts = [None, "", chat_template.FORGED, "<|im_start|>", "<\\|x", "é\n", "<|<|"]
    rows = [(k // 3, k, ("user", "assistant", None)[k % 3], t) for k, t in enumerate(texts * 3)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    for r in chat_template.format_conversations(df).collect():
        said = "".join(chat_template.unescape(r.formatted[s.start : s.end]) for s in r.loss_spans)
        assert said == "".join(t or "" for c, _, role, t in rows if c == r.conv_id and role == "assistant")
        assert r.formatted.count("<|im_start|>") == 3
    with pytest.raises(chat_template.TemplateError):
        chat_template.Template("{{ x.__class__() }}")
    assert chat_template.Template("{% if 1 == 1 %}{{ 'a' ~ 'b' }}{% endif %}c").tree == (chat_template.Output(chat_template.Const("abc")),)


def test_substring_dedup(spark):
    rnd = random.Random(8)
    make = lambda n: " ".join(f"t{rnd.randint(0, 10**6)}" for _ in range(n))
    passage = make(120)
    texts = [make(80), passage, f"{make(40)} {passage} {make(40)}", f"x {passage}", *ODD, make(60)]
    got = {r.doc_id: r for r in substring_dedup.deduplicate(docs(spark, texts)).collect()}
    assert got[0].text == texts[0] and got[len(texts) - 1].text == texts[-1] and got[1].text == passage and got[4].text is None
    for k in (2, 3):
        left = set(got[k].text.split()) & set(passage.split())
        assert len(left) <= 30
    raw = np.frombuffer(passage.encode(), np.uint8)
    h = 0
    for k, byte in enumerate(raw):
        h = (2 * h + int(substring_dedup._GEAR[byte])) & 0xFFFFFFFF
        assert k < 31 or h == substring_dedup.gear_hash(raw)[k]


def test_language(spark):
    d = spark.read.parquet(f"{SF}/documents.parquet")
    model = crf_langid.fit(d)
    rows = crf_langid.identify(d, model).filter(crf_langid.held_out(F.col("doc_id")) & F.col("lang").isNotNull() & (F.col("lang_pred") != "und")).collect()
    assert np.mean([r.lang == r.lang_pred for r in rows]) >= 0.9
    got = crf_langid.identify(docs(spark, ODD), model).collect()
    assert [r.lang_pred == "und" for r in got[:3]] == [True] * 3 and all(0 <= r.crf_score <= 1 for r in got)
    rnd = np.random.default_rng(2)
    scores, moves, words = rnd.normal(size=(4, 3)), rnd.normal(size=(3, 3)), np.array([0, 2, 1, 3])
    weigh = {y: np.exp(sum(scores[w, k] for w, k in zip(words, y)) + sum(moves[a, b] for a, b in zip(y, y[1:]))) for y in itertools.product(range(3), repeat=4)}
    want = np.array([[sum(v for y, v in weigh.items() if y[t] == k) for k in range(3)] for t in range(4)]) / sum(weigh.values())
    assert np.allclose(crf_langid.marginals(scores, words, np.array([4]), moves), want)


def test_url_filter(spark):
    parts = ["http://", "x", "example.net", "A.Example.COM", "/en/", "/de/", "?q=/en/", "#a", ".org", "/fr/x", ".net", "/"]
    rnd = random.Random(5)
    urls = [None, "", "nourl", "http://"] + ["".join(rnd.choice(parts) for _ in range(5)) for _ in range(400)]
    df = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string").withColumn("verdict", F.lit("x"))
    for limit in (100, 1):
        for r in url_filter.judge_urls(df, url_filter.RULES, max_broadcast_rules=limit).collect():
            assert (r.host, r.path, r.rule, r.url_verdict) == url_filter.brute_force(r.url, url_filter.RULES)


@pytest.mark.parametrize(("n", "percent"), [(4, 85), (5, 80), (2, 50)])
def test_jaccard(spark, n, percent):
    texts = copies()
    sets = []
    for t in texts:
        w = re.findall(WORD, (t or "").lower())
        sets.append({tuple(w[k : k + n]) for k in range(len(w) - n + 1)} if len(w) >= n else {tuple(w)} if w else set())
    root = list(range(len(texts)))
    for _ in texts:
        for a, b in itertools.combinations(range(len(texts)), 2):
            if sets[a] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                root[a] = root[b] = min(root[a], root[b])
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_join.jaccard_components(docs(spark, texts), n, percent).collect()}
    assert got == {k: (len(sets[k]), root[k]) for k in range(len(texts))}


def test_sentencepiece():
    import public_tokenizers
    import sentencepiece

    path = public_tokenizers.path("piece_bpe_32k.model")
    lib, own = sentencepiece.SentencePieceProcessor(model_file=path), sentencepiece_codec.codec(path)
    encoder = sentencepiece_codec.encoder(path)
    rnd = random.Random(3)
    texts = [t or "" for t in ODD] + ["".join(rnd.choice("ab▁ é日\n.<0x>😀the") for _ in range(rnd.randint(1, 60))) for _ in range(300)]
    for t in texts:
        ids = lib.encode(t)
        n, joined, decoded = encoder.encode(t)
        assert (n, joined, decoded) == (len(ids), ",".join(map(str, ids)), lib.decode(ids)) and own.decode(ids) == decoded
        spans = own.encode(t)
        assert [p.id for p in spans] == ids and (not spans or spans[-1].end == len(t.encode()))
    assert zlib.crc32(b"1") % 3 in (0, 1, 2)


def test_sentencepiece_query_has_spans_and_decodes_its_ids(spark, monkeypatch):
    import public_tokenizers

    path = public_tokenizers.path("piece_bpe_32k.model")
    own, encoder = sentencepiece_codec.codec(path), sentencepiece_codec.CachedEncoder(sentencepiece_codec.codec(path))
    rnd = random.Random(9)
    texts = [t or "" for t in ODD] + ["".join(rnd.choice("ab▁ é日\n.<0x>😀the") for _ in range(rnd.randint(1, 60))) for _ in range(300)]
    decoded = []
    monkeypatch.setattr(own, "decode", lambda ids, f=own.decode: decoded.append(list(ids)) or f(ids))
    for t in texts * 2:
        ids, starts, ends = (x.tolist() for x in encoder.spans(t))
        assert list(zip(ids, starts, ends)) == [(p.id, p.start, p.end) for p in own.encode(t)]
        assert encoder.encode(t)[0] == len(ids) and decoded[-1] == ids
    got = {r.doc_id: r.pieces for r in sentencepiece_codec.encode_documents(docs(spark, texts), path).collect()}
    for k, t in enumerate(texts):
        assert [(p.id, p.piece, p.start, p.end) for p in got[k]] == [(p.id, p.piece, p.start, p.end) for p in own.encode(t)]
