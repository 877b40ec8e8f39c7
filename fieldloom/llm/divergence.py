"""Source divergence audit: how far the word use of each (lang, source) group lies from that of the language's other sources.

A language keeps the terms of at least ``MIN_DOCS`` of its documents (V of them). With N the group's occurrences of kept terms, each kept
term has the scaled, smoothed share ``p = 1 + floor(SCALE * (count + 1) / (N + V))``; the divergence of p from a share q is
``floor((p - q) ** 2 / q)``. Part ``pair`` sums it over all kept terms for each other source of the language, part ``term`` lists the terms
that a group uses more than its whole language does.

Pairs of groups are made by two-dimensional tiling. The sources of a language are dealt into blocks, its terms into chunks; the counts of
one block and chunk are a packed vector (group numbers, term numbers, counts: at most ``BLOCK * CHUNK`` entries, empty ones left out).
Each packed vector goes to the tiles (block i, block j) of its block and no further, so a group's counts are copied (sources / ``BLOCK``)
times. A tile takes its two vectors chunk after chunk and adds to one submatrix of ``BLOCK`` by ``BLOCK`` sums in either direction: a task
holds two vectors and a submatrix. Long vocabularies are dealt over stripes of ``STRIPE`` chunks, whose submatrices are added. Terms that
neither block has are not visited: all of them add the same amount to a pair, which comes in once at the end.

Counting is combined before each shuffle (in the task first, by document batches), so a source with a third of all rows is many partial sums.
All arithmetic is on 64-bit integers and exact for fewer than 2.8e14 occurrences in a language.

Cases: null text, lang or source read as ''; a group without terms has count 0 for each kept term; a language without kept terms has the
value 0 for each pair and no terms; a language with one source has no pairs; repeated rows count as often as they stand; ties in value
go to the smaller item in UTF-8 order; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from fieldloom.llm.common import bounded_batches, dropped, parts_of, slices, small, stored, tidy, utf8

#: Fixed values of the contract.
MIN_DOCS, TOP_TERMS, SCALE = 3, 200, 1_000_000_000
#: Sources in a block, terms in a chunk (about), chunks in a stripe.
BLOCK, CHUNK, STRIPE = 16, 8192, 8
#: SCALE = FIRST * SECOND: a share is found in two divisions, so that no product leaves 64 bits.
FIRST, SECOND = 31_250, 32_000
#: Bytes and documents that one task counts at once.
HELD, ROWS = 8 << 20, 1 << 16
#: Bytes that are cut into terms at once.
BYTES = 1 << 20
#: Rows of an Arrow batch of counts.
OUT_ROWS = 10_000
#: What each byte of a text is in a term: A-Z in lower case, other ASCII but a-z nothing (0).
LOWER = np.asarray([c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c > 127 else 0 for c in range(256)], np.uint8)
#: The bytes that lie in no term.
BEYOND = re.compile(rb"[\x00-\x40\x5B-\x60\x7B-\x7F]")


def _terms(raw: np.ndarray, offsets: np.ndarray) -> tuple[pa.Array, np.ndarray]:
    """The lower-cased terms of the rows of UTF-8 bytes ``raw``, and the number of terms of each row. The separators are ASCII, so no
    term is cut within a code point."""
    low = LOWER[raw]
    inside = low > 0
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    heads = offsets[:-1][offsets[:-1] < len(raw)]
    first[heads] = inside[heads]
    begins = np.flatnonzero(first)
    at = np.append(np.flatnonzero(first[inside]), np.count_nonzero(inside)).astype(np.int32)
    words = pa.Array.from_buffers(pa.string(), len(begins), [None, pa.py_buffer(at), pa.py_buffer(low[inside])])
    return words, np.diff(np.searchsorted(begins, offsets))


def _blocks(raw: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """First row, bytes and offsets of ranges of rows or parts of a row of about ``BYTES``."""
    for first, last in slices(offsets, BYTES):
        text = raw[offsets[first] : offsets[last]]
        if last - first > 1:
            yield first, text, offsets[first : last + 1] - offsets[first]
            continue
        for part in parts_of(text, BEYOND, BYTES):
            yield first, part, np.asarray([0, len(part)])


def _counted(raw: np.ndarray, offsets: np.ndarray, groups: np.ndarray) -> pa.Table:
    """group, term, n and docs of at most ``ROWS`` rows, each group and term once."""
    words, rows = [], []
    for first, text, own in _blocks(raw, offsets):
        found, per_row = _terms(text, own)
        words.append(found)
        rows.append(np.repeat(np.arange(first, first + len(per_row), dtype=np.int32), per_row))
    if not any(map(len, words)):
        none = pa.array([], pa.int64())
        return pa.table({"group": none, "term": pa.array([], pa.string()), "n": none, "docs": none})
    words = pa.chunked_array(words).dictionary_encode()
    known = words.chunk(0).dictionary  # of all chunks
    size = len(known)
    rows = np.concatenate(rows)
    keys = groups[rows]
    keys *= size
    keys += np.concatenate([chunk.indices.to_numpy() for chunk in words.chunks])
    keys *= ROWS
    keys += rows
    del words, rows
    keys.sort()
    fresh = np.append(True, keys[1:] != keys[:-1])  # a row's first of a term
    keys //= ROWS
    heads = np.flatnonzero(np.append(True, keys[1:] != keys[:-1]))
    docs = np.add.reduceat(fresh, heads, dtype=np.int64)
    found, n = keys[heads], np.diff(heads, append=len(keys))
    return pa.table({"group": found // size, "term": known.take(pa.array(found % size)), "n": n, "docs": docs})


def _counts(table: pa.Table) -> Iterator[pa.Table]:
    """The counts of some documents."""
    raw, offsets = utf8(table.column("text"))
    table = table.drop_columns("text")  # it has been copied
    for begin, end in slices(offsets, HELD):
        for first in range(begin, end, ROWS):
            last = min(end, first + ROWS)
            lang, source = (table.column(name).slice(first, last - first).cast(pa.string()).combine_chunks().fill_null("").dictionary_encode() for name in ("lang", "source"))
            width = len(source.dictionary)
            pairs, groups = np.unique(lang.indices.to_numpy().astype(np.int64) * width + source.indices.to_numpy(), return_inverse=True)
            text = raw[offsets[first] : offsets[last]]
            if last - first > 1 or len(text) <= HELD:
                counts = _counted(text, offsets[first : last + 1] - offsets[first], groups)
            else:
                parts = [_counted(part, np.asarray([0, len(part)]), groups) for part in parts_of(text, BEYOND, HELD)]
                counts = pa.concat_tables(parts).group_by(["group", "term"]).aggregate([("n", "sum"), ("docs", "max")])
                counts = counts.rename_columns({"n_sum": "n", "docs_max": "docs"})
            none = np.zeros(len(pairs), np.int64)
            own = pa.table({"group": np.arange(len(pairs)), "term": pa.repeat("", len(pairs)), "n": none, "docs": none})
            names = {"lang": lang.dictionary.take(pa.array(pairs // width)), "source": source.dictionary.take(pa.array(pairs % width))}
            for found in (own, counts):
                group = found.column("group")
                yield pa.table({key: names[key].take(group) for key in names} | {key: found.column(key) for key in ("term", "n", "docs")})


def term_counts(docs: DataFrame) -> DataFrame:
    """lang, source, term, n (occurrences), docs (documents): partial sums. Term '' stands for the group itself."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def flush() -> Iterator[pa.RecordBatch]:
            found = _counts(pa.Table.from_batches(held)) if held else ()
            held.clear()
            for counts in found:
                yield from counts.to_batches(max_chunksize=OUT_ROWS)

        held: list[pa.RecordBatch] = []
        for batch in batches:
            if sum(b.nbytes for b in (*held, batch)) > HELD or sum(b.num_rows for b in (*held, batch)) > ROWS:
                yield from flush()
            held.append(batch)
        yield from flush()

    return docs.select("lang", "source", "text").mapInArrow(tidy(run), "lang string, source string, term string, n long, docs long")


def div(a: Column, b: Column | int) -> Column:
    """Whole-number quotient."""
    return F.call_function("div", a, b if isinstance(b, Column) else F.lit(b))


def share(count: Column, total: Column, size: Column) -> Column:
    """``1 + floor(SCALE * (count + 1) / (total + size))``, null for an empty vocabulary."""
    a, d = (count + 1) * FIRST, F.when(size > 0, total + size)
    return 1 + div(a, d) * SECOND + div(a % d * SECOND, d)


def shares(counts: np.ndarray, totals: np.ndarray, size: int) -> np.ndarray:
    """The same of a matrix of counts, whose rows have ``totals``."""
    a, d = (counts + 1) * FIRST, (totals + size)[:, None]
    return 1 + a // d * SECOND + a % d * SECOND // d


def vocabulary(docs: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Stored tables: kept terms of groups (lang, source, term, n, lang_n, chunk, place), groups (lang, source, total) and languages
    (lang, size, lang_total, sources)."""
    counts = stored(term_counts(docs).groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs")), "term-counts")
    terms = counts.filter("term != ''").groupBy("lang", "term").agg(F.sum("n").alias("lang_n"), F.sum("docs").alias("docs"))
    terms = stored(terms.filter(F.col("docs") >= MIN_DOCS).drop("docs"), "kept-terms")
    groups = counts.filter("term = ''").select("lang", "source")
    langs = groups.groupBy("lang").agg(F.count("*").alias("sources"))
    sums = terms.groupBy("lang").agg(F.count("*").alias("size"), F.sum("lang_n").alias("lang_total"))
    langs = stored(langs.join(sums, "lang", "left").fillna(0, ["size", "lang_total"]), "languages")
    chunk = F.pmod(F.xxhash64("term"), div(F.col("size") + CHUNK - 1, CHUNK)).cast("int")
    placed = terms.join(small(langs.select("lang", "size")), "lang").withColumn("chunk", chunk).drop("size")
    placed = placed.withColumn("place", F.row_number().over(Window.partitionBy("lang", "chunk").orderBy("term")) - 1)
    kept = stored(counts.drop("docs").join(placed, ["lang", "term"]), "kept-counts")
    totals = kept.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    groups = stored(groups.join(totals, ["lang", "source"], "left").fillna(0, ["total"]), "groups")
    dropped(counts, terms)
    return kept, groups, langs


def _pack(key: tuple[pa.Scalar, ...], rows: pa.Table) -> pa.Table:
    """The packed count vector of one block and chunk: member, place and count of each entry."""
    columns = [rows.column(name).to_numpy().astype(kind) for name, kind in (("member", np.int32), ("place", np.int32), ("n", np.int64))]
    return pa.table({"lang": [key[0].as_py()], "block": pa.array([key[1].as_py()], pa.int32()), "chunk": pa.array([key[2].as_py()], pa.int32()), "packed": [b"".join(c.tobytes() for c in columns)]})


def _unpack(packed: bytes | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    packed = packed or b""
    n = len(packed) // 16
    return np.frombuffer(packed, np.int32, n), np.frombuffer(packed, np.int32, n, 4 * n), np.frombuffer(packed, np.int64, n, 8 * n)


def _dense(entries: tuple[np.ndarray, np.ndarray, np.ndarray], places: np.ndarray, members: int) -> np.ndarray:
    out = np.zeros((members, len(places)), np.int64)
    out[entries[0], np.searchsorted(places, entries[1])] = entries[2]
    return out


def _divergence(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (p - q) ** 2 // q


_TILE = "lang string, source string, item string, value long, seen long, absent long, size long"
_TILE_ARROW = pa.schema([(c.split()[0], pa.int64() if c.endswith("long") else pa.string()) for c in _TILE.split(", ")])


def _tile(key: tuple[pa.Scalar, ...], rows: pa.Table) -> pa.Table:
    """The submatrix of one tile over the chunks of one stripe: value is the sum over terms that either block has, seen their number,
    absent what each other term adds."""
    lang, i, j, _ = (k.as_py() for k in key)
    heads, packs, chunks = {}, {}, set()
    numbers, blocks, vectors = (rows.column(name) for name in ("chunk", "block", "packed"))
    for at, (chunk, block) in enumerate(zip(numbers.to_pylist(), blocks.to_pylist())):
        if chunk < 0:
            heads[block] = at
        else:
            packs[block, chunk] = at
            chunks.add(chunk)
    if i not in heads or j not in heads:  # no source was dealt to one of the blocks
        return _TILE_ARROW.empty_table()
    size = rows.column("size")[0].as_py()
    names = {b: rows.column("names")[at].as_py() for b, at in heads.items()}
    totals = {b: np.asarray(rows.column("totals")[at].as_py(), np.int64) for b, at in heads.items()}
    shape = (len(names[i]), len(names[j]))
    right, left, seen = np.zeros(shape, np.int64), np.zeros(shape, np.int64), 0
    for chunk in sorted(chunks):
        a, b = (_unpack(vectors[packs[k, chunk]].as_py() if (k, chunk) in packs else None) for k in (i, j))
        places = np.unique(np.concatenate([a[1], b[1]]))
        p, q = shares(_dense(a, places, shape[0]), totals[i], size), shares(_dense(b, places, shape[1]), totals[j], size)
        for m in range(shape[0]):
            square = (p[m] - q) ** 2
            right[m] += (square // q).sum(axis=1)
            left[m] += (square // p[m]).sum(axis=1)
        seen += len(places)
    p, q = (shares(np.zeros((len(totals[k]), 1), np.int64), totals[k], size)[:, 0] if size else np.ones(len(totals[k]), np.int64) for k in (i, j))
    out: list[tuple] = []
    for m, name in enumerate(names[i]):
        for n, other in enumerate(names[j]):
            if i != j or m != n:
                out.append((lang, name, other, int(right[m, n]), seen, int(_divergence(p[m], q[n])), size))
            if i != j:
                out.append((lang, other, name, int(left[m, n]), seen, int(_divergence(q[n], p[m])), size))
    return pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), _TILE_ARROW)], schema=_TILE_ARROW) if out else _TILE_ARROW.empty_table()


def pair_divergence(kept: DataFrame, groups: DataFrame, langs: DataFrame, block: int = BLOCK, stripe: int = STRIPE) -> DataFrame:
    """lang, source, item (another source) and value of every ordered pair of a language's sources."""
    blocks = div(F.col("sources") + block - 1, block).cast("int")
    stripes = F.greatest(F.lit(1), div(div(F.col("size") + CHUNK - 1, CHUNK) + stripe - 1, stripe)).cast("int")
    langs = small(langs.select("lang", "size", blocks.alias("blocks"), stripes.alias("stripes")))
    members = groups.join(langs, "lang").withColumn("block", F.pmod(F.xxhash64("source"), F.col("blocks")).cast("int"))
    members = members.withColumn("member", F.row_number().over(Window.partitionBy("lang", "block").orderBy("source")) - 1)
    members = stored(members, "members")
    heads = members.groupBy("lang", "block", "size", "blocks", "stripes").agg(F.sort_array(F.collect_list(F.struct("member", "source", "total"))).alias("m"))
    heads = heads.select("lang", "block", "size", "blocks", F.col("m.source").alias("names"), F.col("m.total").alias("totals"), F.explode(F.sequence(F.lit(0), F.col("stripes") - 1)).alias("stripe"))
    heads = heads.withColumn("chunk", F.lit(-1)).withColumn("packed", F.lit(None).cast("binary"))
    entries = kept.select("lang", "source", "chunk", "place", "n").join(small(members.select("lang", "source", "block", "member")), ["lang", "source"])
    packs = entries.select("lang", "block", "chunk", "member", "place", "n").groupBy("lang", "block", "chunk")
    packs = packs.applyInArrow(_pack, "lang string, block int, chunk int, packed binary").join(langs, "lang")
    packs = packs.select(
        "lang", "block", "size", "blocks", F.lit(None).cast("array<string>").alias("names"), F.lit(None).cast("array<long>").alias("totals"),
        div(F.col("chunk"), stripe).cast("int").alias("stripe"), "chunk", "packed",
    )
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    tiles = heads.unionByName(packs).withColumn("other", other)
    tiles = tiles.withColumns({"i": F.least("block", "other"), "j": F.greatest("block", "other")}).drop("other", "blocks")
    sums = tiles.groupBy("lang", "i", "j", "stripe").applyInArrow(_tile, _TILE)
    sums = sums.groupBy("lang", "source", "item").agg(F.sum("value").alias("value"), F.sum("seen").alias("seen"), F.max("absent").alias("absent"), F.max("size").alias("size"))
    return sums.select("lang", "source", "item", (F.col("value") + (F.col("size") - F.col("seen")) * F.col("absent")).alias("value"))


def term_divergence(kept: DataFrame, groups: DataFrame, langs: DataFrame, top: int = TOP_TERMS) -> DataFrame:
    """lang, source, item (term), value and rank of the ``top`` terms that each group uses more than its language."""
    p, q = share(F.col("n"), F.col("total"), F.col("size")), share(F.col("lang_n"), F.col("lang_total"), F.col("size"))
    found = kept.select("lang", "source", "term", "n", "lang_n").join(small(groups), ["lang", "source"]).join(small(langs.drop("sources")), "lang")
    found = found.select("lang", "source", F.col("term").alias("item"), p.alias("p"), q.alias("q")).filter("p > q")
    found = found.select("lang", "source", "item", div((F.col("p") - F.col("q")) * (F.col("p") - F.col("q")), F.col("q")).alias("value"))
    return found.withColumn("rank", F.row_number().over(_ranks())).filter(F.col("rank") <= top)


def _ranks() -> Window:
    return Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")


def audit(docs: DataFrame, top: int = TOP_TERMS, block: int = BLOCK, stripe: int = STRIPE) -> DataFrame:
    """lang, source, part (pair or term), item, value and rank."""
    bounded_batches(docs.sparkSession)
    kept, groups, langs = vocabulary(docs)
    pairs = pair_divergence(kept, groups, langs, block, stripe).withColumn("rank", F.row_number().over(_ranks()))
    terms = term_divergence(kept, groups, langs, top)
    columns = ("lang", "source", "part", "item", "value", "rank")
    return pairs.withColumn("part", F.lit("pair")).select(*columns).unionByName(terms.withColumn("part", F.lit("term")).select(*columns))


def op12_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The audit of all documents."""
    return audit(spark.read.parquet(f"{sf_dir}/documents.parquet").select("lang", "source", "text"))


OP12_SQL = r"""
with words as (
  select doc, lang, source, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) as term
  from (select row_number() over () as doc, coalesce(text, '') as text, coalesce(lang, '') as lang, coalesce(source, '') as source from documents)
), counted as (select lang, source, term, count(*) as n from words group by all),
terms as (select lang, term, count(*) as lang_n from words group by all having count(distinct doc) >= 3),
groups as (select distinct coalesce(lang, '') as lang, coalesce(source, '') as source from documents),
kept as (select g.lang, g.source, t.term, coalesce(c.n, 0) as n, t.lang_n from groups g join terms t using (lang) left join counted c using (lang, source, term)),
sized as (
  select *, sum(n) over (partition by lang, source) as total, count(*) over (partition by lang, source) as size, sum(lang_n) over (partition by lang, source) as lang_total from kept
), shared as (
  select lang, source, term, n, (1 + (1000000000 * (n + 1)::hugeint) // (total + size))::bigint as p, (1 + (1000000000 * (lang_n + 1)::hugeint) // (lang_total + size))::bigint as q from sized
), pairs as (
  select g.lang, g.source, o.source as item, coalesce(v.value, 0) as value
  from groups g join groups o on g.lang = o.lang and g.source <> o.source
  left join (
    select a.lang, a.source, b.source as item, sum((a.p - b.p) * (a.p - b.p) // b.p)::bigint as value
    from shared a join shared b on a.lang = b.lang and a.term = b.term and a.source <> b.source group by all
  ) v on v.lang = g.lang and v.source = g.source and v.item = o.source
), terms_of as (select lang, source, term as item, (p - q) * (p - q) // q as value from shared where n > 0 and p > q),
ranked as (
  select lang, source, 'pair' as part, item, value, row_number() over (partition by lang, source order by value desc, item)::int as rank from pairs
  union all select lang, source, 'term', item, value, row_number() over (partition by lang, source order by value desc, item)::int from terms_of
)
select lang, source, part, item, value, rank from ranked where part = 'pair' or rank <= 200
"""
