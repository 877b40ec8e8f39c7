"""Spelling variants: words one edit apart, found by a positional q-gram inverted index with a count filter.

Two words are near if they differ by exactly one inserted, deleted or replaced code point. One edit leaves one half of the shorter word as it
is, so the index is dealt over Spark by frames: a frame is the shorter word's length, the open stretch that holds the edit, and the text around it.
A word is in the frames of its two halves as a word of its length, and as the longer one of a pair. Every near pair meets in exactly one frame: the
open stretches of a length cover each place once, and the place of an edit is the length of the words' common beginning. A frame of more than
``LIMIT`` words is split: its words go to the two frames whose open stretch is one half of it, again and again down to one code point, where the
alphabet bounds a frame's words. Frame sizes are counted (combined before the shuffle) before any word is sent, so no common beginning or
ending fills a task, and no pair is lost.

Inside a frame, in a task: the index maps each (q-gram, place) of the open stretch to its sorted postings, the words of the frame that have it
there, one index a length. For each word the postings of its own grams are merged by a heap, at the same place for equal lengths, at the same place or the next
one for a word longer by one. One replacement destroys at most q of a word's grams, one insertion q - 1: words met less often than the bound are dropped,
the others are verified. A frame hands on one row a word: its number of near words and the best of them.

The form of a word is its near word of greatest n, if that is at least ``RATIO`` times its own. n grows by that at each step towards the root, so pointer
doubling ends after a few joins.

Cases: a null or empty text has no words; a null id is written as empty in the checksum; repeated rows count as often as they stand; a word met once is none;
ties in n go to the smaller word in code-point order; words of any length take part whole; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import heapq
import re
import zlib
from bisect import bisect_right
from collections import Counter, defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldloom.llm.common import ascii_lower, bounded_batches, dropped, parts_of, small, stored, tidy

#: Fixed values of the contract: letters of a word, its least length and occurrences, the checksum's modulus, form's least multiple.
LETTERS = "A-Za-zÀ-ÿ"
MIN_LENGTH, MIN_COUNT, MODULUS, RATIO = 7, 2, 31, 10
#: Length of a gram; most words of a frame that is not split.
Q, LIMIT = 2, 256
#: Distinct words that one task holds before it hands their counts on.
HELD = 300_000


def word_counts(docs: DataFrame, min_length: int = MIN_LENGTH, min_count: int = MIN_COUNT) -> DataFrame:
    """word, n: the runs of letters in lower case, each with one code point less where its document's checksum says so."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find, beyond = re.compile(f"[{LETTERS}]{{{min_length},}}"), re.compile(f"[^{LETTERS}]")
        found: Counter = Counter()

        def flush() -> Iterator[pa.RecordBatch]:
            words = list(found)
            for at in range(0, len(words), 50_000):
                part = words[at : at + 50_000]
                yield pa.RecordBatch.from_pydict({"word": pa.array(part, pa.string()), "n": pa.array([found[w] for w in part], pa.int64())})
            found.clear()

        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                own: Counter = Counter()
                for part in parts_of(text or "", beyond):
                    own.update(find.findall(ascii_lower(part)))
                start = zlib.crc32(("" if doc_id is None else f"{doc_id}").encode() + b":")
                for word, n in own.items():
                    check = zlib.crc32(word.encode(), start)
                    if check % MODULUS == 0:
                        at = check % len(word)
                        word = word[:at] + word[at + 1 :]
                        if len(word) < min_length:
                            continue
                    found[word] += n
            if len(found) > HELD:
                yield from flush()
        yield from flush()

    counts = docs.select("doc_id", "text").mapInArrow(tidy(run), "word string, n long")
    return counts.groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= min_count)


FRAME = ("size", "first", "last", "around")


def _cut(word: Column, first: Column, last: Column) -> Column:
    """``word`` without the code points from ``first`` (counted from 0) up to ``last``."""
    return F.concat(word.substr(F.lit(1), first), word.substr(last + 1, F.length(word)))


def _halves(size: Column, first: Column, last: Column, longer: Column) -> Column:
    """The two frames whose open stretches are the halves of [first, last)."""
    middle = F.floor((first + last) / 2).cast("int")
    frames = [
        F.struct(size.alias("size"), a.alias("first"), b.alias("last"), _cut(F.col("word"), a, b + longer).alias("around"), longer.alias("longer"))
        for a, b in ((first, middle), (middle, last))
    ]
    return F.array(*frames)


def frames_of(words: DataFrame, min_length: int = MIN_LENGTH) -> DataFrame:
    """Each word in the frames of its halves, as one of its length and as the longer one of a pair."""
    length = F.length("word")
    own = _halves(length, F.lit(0), length, F.lit(0))
    longer = F.when(length > min_length, _halves(length - 1, F.lit(0), length - 1, F.lit(1))).otherwise(F.array().cast("array<struct<size:int,first:int,last:int,around:string,longer:int>>"))
    return words.select("word", "n", F.explode(F.concat(own, longer)).alias("f")).select("f.*", "word", "n")


def split_frames(frames: DataFrame) -> DataFrame:
    """The words of frames in the two frames each of half the open stretch."""
    halves = _halves(F.col("size"), F.col("first"), F.col("last"), F.col("longer"))
    return frames.select("word", "n", F.explode(halves).alias("f")).select("f.*", "word", "n")


def one_edit(short: str, longer: str) -> int:
    """The place of the one edit that makes ``longer`` (as long, or longer by one) of ``short``; -1 if they are not near."""
    at = 0
    for a, b in zip(short, longer):
        if a != b:
            break
        at += 1
    same = len(short) == len(longer)
    if same and at == len(short):
        return -1
    return at if short[at + same :] == longer[at + 1 :] else -1


class Index:
    """Positional postings of one length: (gram, place) -> numbers of the words that have it, ascending."""

    def __init__(self, words: list[str], places: range, q: int) -> None:
        self.postings: dict[tuple[str, int], list[int]] = defaultdict(list)
        for number, word in enumerate(words):
            for place in places:
                self.postings[word[place : place + q], place].append(number)

    def lists(self, word: str, places: range, q: int, shifts: tuple[int, ...]) -> list[list[int]]:
        """The postings of each of the word's grams at its place moved by ``shifts`` (a gram's lists are one: it counts once)."""
        out = []
        for place in places:
            gram = word[place : place + q]
            found = [p for p in (self.postings.get((gram, place + s)) for s in shifts) if p]
            if found:
                out.append(found[0] if len(found) == 1 else sorted({*found[0], *found[1]}))
        return out


def met_often(lists: list[list[int]], bound: int, after: int = -1) -> Iterator[int]:
    """The numbers beyond ``after`` in at least ``bound`` of the sorted lists, by a heap merge."""
    if after >= 0:
        lists = [p[bisect_right(p, after) :] for p in lists]
    last, times = -1, 0
    for number in heapq.merge(*lists):
        if number == last:
            times += 1
        else:
            last, times = number, 1
        if times == bound:
            yield number


def near_in_frame(size: int, first: int, last: int, words: list[str], longer: list[str], q: int = Q) -> Iterator[tuple[int, int, bool]]:
    """(number in ``words``, number in ``words`` or ``longer``, is the other longer) of each near pair of one frame."""
    places = range(max(0, first - q + 1), min(last, size - q + 1))
    equal, wide = Index(words, places, q), None
    if longer:
        wide = Index(longer, range(places.start, min(places.stop + 1, size + 2 - q)), q)
    bound, wide_bound = len(places) - q, len(places) - (q - 1)
    for number, word in enumerate(words):
        others = met_often(equal.lists(word, places, q, (0,)), bound, number) if bound > 0 else range(number + 1, len(words))
        for other in others:
            if one_edit(word, words[other]) >= 0:
                yield number, other, False
        if wide is None:
            continue
        others = met_often(wide.lists(word, places, q, (0, 1)), wide_bound) if wide_bound > 0 else range(len(longer))
        for other in others:
            at = one_edit(word, longer[other])
            if first <= at < last or at == last == size:  # the frame of this place, if the word has several
                yield number, other, True


def near_words(frames: DataFrame, q: int = Q) -> DataFrame:
    """word, n_near, best_n, best of each frame in which a word has near words."""

    def of_frame(key: tuple, rows: list[tuple[str, int, int]], out: dict[str, list]) -> None:
        members = ([], [])
        for word, n, is_longer in rows:
            members[is_longer].append((word, n))
        words, longer = [w for w, _ in members[0]], [w for w, _ in members[1]]
        if not words or len(words) + len(longer) < 2:
            return
        best: dict[str, list] = {}
        for a, b, is_longer in near_in_frame(*key[:3], words, longer, q):
            (word, n), (other, m) = members[0][a], members[is_longer][b]
            for w, o, k in ((word, other, m), (other, word, n)):
                mine = best.get(w)
                if mine is None:
                    best[w] = [1, k, o]
                else:
                    mine[0] += 1
                    if (-k, o) < (-mine[1], mine[2]):
                        mine[1:] = k, o
        for w, (near, k, o) in best.items():
            for name, value in zip(("word", "n_near", "best_n", "best"), (w, near, k, o)):
                out[name].append(value)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("word", pa.string()), ("n_near", pa.int64()), ("best_n", pa.int64()), ("best", pa.string())])
        out: dict[str, list] = defaultdict(list)
        key, rows = None, []
        for batch in batches:
            for *frame, is_longer, word, n in zip(*(column.to_pylist() for column in batch.columns)):
                if frame != key:
                    if len(rows) > 1:
                        of_frame(key, rows, out)
                    key, rows = frame, []
                rows.append((word, n, is_longer))
            if len(out["word"]) > 10_000:
                yield pa.RecordBatch.from_pydict(out, schema=schema)
                out.clear()
        if len(rows) > 1:
            of_frame(key, rows, out)
        if out:
            yield pa.RecordBatch.from_pydict(out, schema=schema)

    # frames arrive one after the other: a task holds one frame's words
    dealt = frames.select(*FRAME, "longer", "word", "n").repartition(*FRAME).sortWithinPartitions(*FRAME)
    return dealt.mapInArrow(tidy(run), "word string, n_near long, best_n long, best string")


def near_table(words: DataFrame, min_length: int = MIN_LENGTH, q: int = Q, limit: int = LIMIT) -> DataFrame:
    """word, n_near and the best near word (best_n, best) of every word that has near words; ``words`` is stored."""
    frames, found = frames_of(words, min_length), []
    while True:
        sizes = frames.groupBy(*FRAME).agg(F.count("*").alias("members"))
        large = stored(sizes.filter((F.col("members") > limit) & (F.col("last") - F.col("first") > 1)).drop("members"), "large-frames")
        if large.isEmpty():
            found.append(stored(near_words(frames, q), "near"))
            break
        held = small(large)
        found.append(stored(near_words(frames.join(held, list(FRAME), "left_anti"), q), "near"))
        frames = stored(split_frames(frames.join(held, list(FRAME), "left_semi")), "frames")
    near = found[0]
    for more in found[1:]:
        near = near.unionByName(more)
    best = F.min(F.struct((-F.col("best_n")).alias("n"), F.col("best").alias("word"))).alias("b")
    return near.groupBy("word").agg(F.sum("n_near").alias("n_near"), best).select("word", "n_near", (-F.col("b.n")).alias("best_n"), F.col("b.word").alias("best"))


def with_roots(forms: DataFrame) -> DataFrame:
    """word, root of a stored table (word, form) whose chains end: pointer doubling."""
    links = forms.select("word", F.col("form").alias("root"))
    while True:
        ahead = links.select(F.col("word").alias("root"), F.col("root").alias("further"))
        moved = stored(links.join(ahead, "root", "left").select("word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved")), "roots")
        links = moved.select("word", "root")
        if moved.filter("moved").isEmpty():
            return links


def spelling_variants(docs: DataFrame, min_length: int = MIN_LENGTH, min_count: int = MIN_COUNT, ratio: int = RATIO, q: int = Q, limit: int = LIMIT) -> DataFrame:
    """word, n, n_near, form, form_n and root of every word of ``docs`` (doc_id, text)."""
    if min_length < 2 or q < 2:
        raise ValueError("words and grams have two code points at least")
    bounded_batches(docs.sparkSession)
    words = stored(word_counts(docs, min_length, min_count), "words")
    is_form = F.col("best_n") >= ratio * F.col("n")
    joined = words.join(near_table(words, min_length, q, limit), "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), F.when(is_form, F.col("best")).alias("form"), F.when(is_form, F.col("best_n")).alias("form_n")
    )
    joined = stored(joined, "variants")
    dropped(words)
    roots = with_roots(joined.filter("form is not null"))
    return joined.join(roots, "word", "left").withColumn("root", F.coalesce("root", "word"))


def op11_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The words of all documents with their forms."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return spelling_variants(docs).select("word", "form", "root", "n", "n_near", "form_n")


OP11_SQL = r"""
with recursive bits(code, c, step) as (
  select range, range, 0 from range(256)
  union all select code, case when c % 2 = 1 then xor(c // 2, 3988292384) else c // 2 end, step + 1 from bits where step < 8
), crc as (select list(c order by code) as entry from bits where step = 8),
runs as (
  select doc_id, translate(run, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as run
  from (select doc_id, unnest(regexp_extract_all(text, '[A-Za-z\x{C0}-\x{FF}]+')) as run from documents) where length(run) >= 7
), own as (select coalesce(doc_id::varchar, '') || ':' || run as key, run, count(*) as n from runs group by all),
bytes as (
  select run, n, list_transform(range(octet_length(encode(key))), lambda i: ('0x' || substr(hex(encode(key)), 2 * i::int + 1, 2))::bigint) as b from own
), hashed as (
  select run, n, xor(4294967295, list_reduce(list_prepend(4294967295, b), lambda c, x: xor(c // 256, entry[xor(c % 256, x) + 1]))) as h from bytes, crc
), edited as (
  select case when h % 31 = 0 then substr(run, 1, (h % length(run))::int) || substr(run, (h % length(run))::int + 2) else run end as word, n from hashed
), words as (select word, sum(n)::bigint as n from edited where length(word) >= 7 group by word having sum(n) >= 2),
less as (select distinct word, substr(word, 1, i::int) || '*' || substr(word, i::int + 2) as star, substr(word, 1, i::int) || substr(word, i::int + 2) as rest from (select word, unnest(range(length(word))) as i from words)),
near as (
  select a.word, b.word as other from (select distinct word, star from less) a join (select distinct word, star from less) b on a.star = b.star and a.word <> b.word
  union select w.word, l.word from words w join less l on l.rest = w.word
  union select l.word, w.word from words w join less l on l.rest = w.word
), joined as (
  select near.word, near.other, w.n as other_n, row_number() over (partition by near.word order by w.n desc, near.other) as place, count(*) over (partition by near.word) as n_near
  from near join words w on w.word = near.other
), formed as (
  select w.word, w.n, coalesce(j.n_near, 0) as n_near, case when j.other_n >= 10 * w.n then j.other end as form, case when j.other_n >= 10 * w.n then j.other_n end as form_n
  from words w left join joined j on j.word = w.word and j.place = 1
), chain(word, here, step) as (
  select word, word, 0 from formed union all select c.word, f.form, c.step + 1 from chain c join formed f on f.word = c.here where f.form is not null
), roots as (select word, arg_max(here, step) as root from chain group by word)
select f.word, f.form, r.root, f.n, f.n_near, f.form_n from formed f join roots r using (word)
"""
