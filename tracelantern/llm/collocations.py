"""Phrase collocations from a weighted de Bruijn graph of words.

Nodes are grams of m - 1 words, edges are grams of m words between overlapping nodes,
weighted by their occurrences.  A task builds the graph of some megabytes of text at a
time, and sends its unary paths, through which all flow goes on, as one row each; Spark
takes the paths apart and adds the edges up.  No shorter gram is counted: the flow that
leaves a gram, the sum of the longer grams that start with it, plus the pieces that end in
it, is its count, level by level down to the number of all words.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tracelantern.functions.stages import drop, kept, new_path
from tracelantern.llm.shared import slices
from tracelantern.operators.ranking import first_rows

MAX_WORDS = 3
LEAST_COUNT = 10
# A phrase goes if a longer one has this many percent of its occurrences.
ABSORBED = 50
TOP = 2000
# Text in one graph; a longer text is several graphs, cut between pieces or within one.
BLOCK_BYTES = 8 << 20
# Words with more than twice this share of all words may make a node hot; its edges go to so many parts.
HOT_SHARE, HOT_PARTS = 2000, 64
# Marks that no word holds or that stand where no word does.
HOT, SALTED, UNFINISHED = b",", "~", "="

_BREAK = b"\xff"  # no byte of UTF-8
_MARKS = b".,;:!?\n\x0b\x0c\r"
_TABLE = bytes.maketrans(
    bytes(range(65, 91)) + _MARKS, bytes(range(97, 123)) + _BREAK * len(_MARKS)
)
_SPACE = re.compile(rb"[ \t\xff]")
_PATHS = pa.schema([("lang", pa.string()), ("words", pa.list_(pa.string())), ("weight", pa.int64())])


def blocks(texts: Iterator[bytes], m: int, size: int = BLOCK_BYTES) -> Iterator[np.ndarray]:
    """``(names, ids)`` of blocks of text; 0 in ids ends a piece.

    A block that ends inside a piece has no 0 at its end, and the next one starts with its
    last m - 1 words.
    """
    held, length = [], 0
    for text in texts:
        text = text.translate(_TABLE) + _BREAK
        if len(text) > size:
            if held:
                yield _numbered(b"".join(held).replace(_BREAK, b" \xff ").split())
                held, length = [], 0
            yield from _long_text(text, m, size)
            continue
        held.append(text)
        length += len(text)
        if length >= size:
            yield _numbered(b"".join(held).replace(_BREAK, b" \xff ").split())
            held, length = [], 0
    if held:
        yield _numbered(b"".join(held).replace(_BREAK, b" \xff ").split())


def _long_text(text: bytes, m: int, size: int) -> Iterator[tuple[list[bytes], np.ndarray]]:
    start, carried = 0, []
    while start < len(text):
        cut = _SPACE.search(text, min(start + size, len(text)) - 1)
        end = cut.end() if cut else len(text)
        words = carried + text[start:end].replace(_BREAK, b" \xff ").split()
        start = end
        if start >= len(text):
            yield _numbered(words)
        elif words:
            yield _numbered(words)
            tail = words[-(m - 1):] if m > 1 else []
            carried = tail[len(tail) - tail[::-1].index(_BREAK):] if _BREAK in tail else tail


def _numbered(words: list[bytes]) -> tuple[list[bytes], np.ndarray]:
    numbers: defaultdict[bytes, int] = defaultdict()
    numbers.default_factory = numbers.__len__
    numbers[_BREAK]
    ids = np.fromiter(map(numbers.__getitem__, words), np.int64, len(words))
    return list(numbers), ids


def _grams(ids: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Places of all grams of a length, and dense numbers of the grams."""
    places = np.flatnonzero(ids > 0)
    code = ids
    for k in range(1, length):
        places = places[places + k < len(ids)]
        places = places[ids[places + k] > 0]
        both = code[places] * (int(ids.max()) + 1) + ids[places + k]
        dense = np.unique(both, return_inverse=True)[1]
        code = np.zeros(len(ids), np.int64)
        code[places] = dense
    return places, code[places]


def paths(ids: np.ndarray, m: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """``(words, offsets, weights)`` of the graph of a block: unary paths, then piece ends.

    Every full gram lies in exactly one path.  A piece end is a row of fewer than m words,
    which says that so many pieces end in these words.
    """
    if not len(ids) or not ids.any():
        return
    whole, size = np.append(ids, -1), len(ids)
    node_at, node = _grams(ids, m - 1) if m > 1 else (np.flatnonzero(ids > 0), np.zeros(size, np.int64)[ids > 0])
    at_place = np.full(size + 1, -1, np.int64)
    at_place[node_at] = node
    tails = node_at[(node_at + m - 1 < size) & (whole[np.minimum(node_at + m - 1, size)] > 0)]
    nodes = int(node.max()) + 1 if len(node) else 0
    if len(tails):
        u, v = at_place[tails], at_place[tails + 1] if m > 1 else ids[tails]
        _, first, weight = np.unique(u * (int(v.max()) + 1) + v, return_index=True, return_counts=True)
        u, v, place = u[first], v[first], tails[first]
        through = np.zeros(nodes, bool)
        before, after = np.zeros(nodes, np.int64), np.zeros(nodes, np.int64)
        if m > 1:
            out, into = np.bincount(u, minlength=nodes), np.bincount(v, minlength=nodes)
            before[v], after[u] = np.arange(len(v)), np.arange(len(u))
            through = (out == 1) & (into == 1)
            through &= weight[before] == weight[after]
            # pieces start or end here, or the block does
            through[at_place[node_at[(node_at == 0) | (whole[node_at - 1] <= 0)]]] = False
            through[at_place[node_at[whole[node_at + m - 1] <= 0]]] = False
        # each edge looks back along its path, twice as far each time
        head = np.where(through[u], before[u], np.arange(len(u)))
        steps = through[u].astype(np.int64)
        while (far := steps + steps[head]).max(initial=0) and not np.array_equal(head[head], head):
            steps, head = far, head[head]
        order = np.lexsort((steps, head))
        starts = np.flatnonzero(np.diff(head[order], prepend=-1))
        # the first edge of a path gives all its words, each other its last
        count = np.ones(len(order), np.int64)
        count[starts] = m
        last = np.cumsum(count) - 1
        back = np.arange(int(count.sum())) - np.repeat(last, count)
        words = ids[np.repeat(place[order] + m - 1, count) + back]
        offsets = np.append(last[starts] - m + 1, len(words))
        yield words, offsets, weight[order][starts]
    for k in range(1, m):
        ends = np.flatnonzero(ids == 0) - k
        ends = ends[ends >= 0]
        for j in range(k):
            ends = ends[ids[ends + j] > 0]
        if not len(ends):
            break
        code = ids[ends]
        for j in range(1, k):
            code = np.unique(code * (int(ids.max()) + 1) + ids[ends + j], return_inverse=True)[1]
        _, first, weight = np.unique(code, return_index=True, return_counts=True)
        words = ids[(ends[first][:, None] + np.arange(k)).ravel()]
        yield words, np.arange(len(first) + 1) * k, weight


def _by_lang(batches: Iterator[pa.RecordBatch], m: int) -> Iterator[tuple[str, list[bytes], np.ndarray]]:
    for batch in slices(batches, BLOCK_BYTES):
        langs = batch.column(0).to_pylist()
        texts = batch.column(1).cast(pa.binary())
        for lang in dict.fromkeys(langs):
            own = (texts[k].as_py() for k, each in enumerate(langs) if each == lang)
            yield from ((lang, *block) for block in blocks(own, m))


def _frequent(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Words with a share of 1 / HOT_SHARE in their block, and the size of the block under a null word."""
    for lang, names, ids in _by_lang(batches, 1):
        count = np.bincount(ids, minlength=len(names))
        count[0] = 0
        total = int(count.sum())
        held = np.flatnonzero(count * HOT_SHARE >= max(1, total))
        words = [None, *(names[k].decode() for k in held)]
        columns = [pa.array([lang] * len(words), pa.string()), pa.array(words, pa.string()), pa.array([total, *count[held].tolist()], pa.int64())]
        yield pa.RecordBatch.from_arrays(columns, names=["lang", "word", "n"])


def hot_words(texts: DataFrame) -> frozenset[tuple[str, bytes]]:
    """All words with twice a share of 1 / HOT_SHARE of all words, and fewer than HOT_SHARE in all.

    Blocks in which a word is rarer hold back less than that share of it, so what they
    send decides.
    """
    path = new_path(texts.sparkSession)
    sums = texts.mapInArrow(_frequent, "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n"))
    sums = kept(sums, path=path)
    total = sums.where(F.col("word").isNull()).agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    found = sums.where(F.col("word").isNotNull() & (F.col("n") * HOT_SHARE > total)).select("lang", "word").collect()
    drop(texts.sparkSession, path)
    return frozenset((r.lang, r.word.encode()) for r in found)


def _graphs(batches: Iterator[pa.RecordBatch], m: int, hot: frozenset) -> Iterator[pa.RecordBatch]:
    """Paths of words; a hot word has HOT before it."""
    for lang, names, ids in _by_lang(batches, m):
        words = pa.array([HOT + name if (lang, name) in hot else name for name in names], pa.binary())
        for flat, offsets, weight in paths(ids, m):
            for start in range(0, len(weight), 1 << 16):
                stop = min(start + (1 << 16), len(weight))
                used = flat[offsets[start]:offsets[stop]]
                listed = pa.ListArray.from_arrays(
                    pa.array((offsets[start:stop + 1] - offsets[start]).astype(np.int32)), words.take(pa.array(used)).cast(pa.string())
                )
                yield pa.RecordBatch.from_arrays([pa.array([lang] * (stop - start), pa.string()), listed, pa.array(weight[start:stop])], schema=_PATHS)


def _dealt(m: int) -> tuple[Column, Column]:
    """``deal`` and ``rest`` of the gram of up to m words at place ``at`` of ``words``.

    Grams meet by their first word, and by one word more for each hot word that they
    start with; if the first m - 1 are hot, by a part of the last words.  ``deal`` tells how
    many are hot, ``rest`` has the words after those that it names.  Every count from
    that number of words on is whole where it is dealt to.
    """
    at = F.col("at")
    size = F.least(F.size("words"), F.lit(m))
    word = [F.get("words", at + (k - 1)) for k in range(m)]
    tail = F.concat(F.lit("\t"), F.col("lang"))

    def joined(first: int, most: int) -> Column:
        return F.array_join(F.slice("words", at + first, most), " ")

    def chosen(cold: list[Column], all_hot: Column, ends: Column) -> Column:
        found = F.when(size == m, all_hot).otherwise(ends)
        for k in range(m - 2, -1, -1):
            found = F.when((size > k) & ~word[k].startswith(HOT.decode()), cold[k]).otherwise(found)
        return found

    salt = F.lpad(F.pmod(F.hash(word[m - 1]), F.lit(HOT_PARTS)).cast("string"), 2, "0")
    deal = chosen(
        [F.concat(F.lit(str(k)), joined(0, k + 1), tail) for k in range(m - 1)],
        F.concat(F.lit(SALTED), salt, joined(0, m - 1), tail), F.concat(F.lit(UNFINISHED), joined(0, m), tail),
    )
    return deal.alias("deal"), chosen([joined(k + 1, m - 1 - k) for k in range(m - 1)], word[m - 1], F.lit("")).alias("rest")


def gram_counts(documents: DataFrame, max_words: int = MAX_WORDS, least: int = LEAST_COUNT) -> DataFrame:
    """``lang, phrase, k, f``: grams of up to ``max_words`` words with at least ``least`` occurrences.

    A row with k = 0 has the number of all words of a language.  One shuffle brings the
    edges together; flows from nodes to shorter grams stay where they are, but for those
    of hot words, which are few.
    """
    m = max_words
    lang = F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang")
    texts = documents.select(lang, F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    hot = hot_words(texts)
    sent = texts.mapInArrow(lambda batches: _graphs(batches, m, hot), "lang string, words array<string>, weight long")
    places = F.sequence(F.lit(1), F.greatest(F.size("words") - m + 1, F.lit(1)))
    rows = sent.select("*", F.explode(places).alias("at")).select(*_dealt(m), F.col("weight").alias("f"))
    # graphs have summed already, a task would find few equal rows
    rows = rows.repartition("deal")
    deal, rest, f, total = F.col("deal"), F.col("rest"), F.col("f"), F.sum("f").alias("f")
    left = F.when(rest == "", 0).otherwise(F.length(rest) - F.length(F.replace(rest, F.lit(" "))) + 1)
    for k in range(m - 1, 0, -1):
        rows = rows.groupBy("deal", "rest").agg(total)
        itself = F.array(F.struct("rest", "f"))
        flow = F.array(F.struct(F.substring_index(rest, " ", k - 1).alias("rest"), "f"))
        passed = F.when(f >= least, F.concat(flow, itself)).otherwise(flow)
        # the column that rows were dealt by stays as it is, so they are not dealt again
        rows = rows.select("deal", F.inline(F.when((left == k) & ~deal.startswith(SALTED), passed).otherwise(itself)))
    rows = rows.groupBy("deal", "rest").agg(total)
    # from here on a gram, its number of words and its language are one short text; no word holds a tab
    salted, unfinished = deal.startswith(SALTED), deal.startswith(UNFINISHED)
    named = F.substring(deal, F.when(salted, 4).otherwise(2), F.lit(1 << 30))
    words, lang = F.substring_index(named, "\t", 1), F.substring(named, F.instr(named, "\t") + 1, F.lit(1 << 30))
    whole = F.when(rest == "", words).otherwise(F.concat(words, F.lit(" "), rest))
    rows = rows.select(whole.alias("words"), lang.alias("lang"), "f", (salted | (rest == "") & ~unfinished).alias("flows"), unfinished.alias("part"))
    rows = rows.select(F.inline(_passed_on(least, F.col("flows"), F.col("part"))))
    for k in range(m - 1, -1, -1):
        # whole counts have no further row; parts meet level by level
        rows = rows.groupBy("lang", "words", "part").agg(total)
        if k:
            now = F.col("part") & (_count(F.col("words")) == k)
            rows = rows.select("lang", "words", "f", now.alias("flows"), (F.col("part") & ~now).alias("part"))
            rows = rows.select(F.inline(_passed_on(least, F.col("flows"), F.col("part"))))
    phrase = F.replace(F.col("words"), F.lit(HOT.decode())).alias("phrase")
    return rows.select("lang", phrase, _count(F.col("words")).alias("k"), "f").where((F.col("f") >= least) | (F.col("k") == 0))


def _count(words: Column) -> Column:
    return F.when(words == "", 0).otherwise(F.length(words) - F.length(F.replace(words, F.lit(" "))) + 1)


def _passed_on(least: int, flows: Column, part: Column) -> Column:
    """Rows (lang, words, f, part) that a count leaves: a whole one itself if frequent, and its flow as a part."""
    def row(words: Column, part: Column) -> Column:
        return F.struct("lang", words.alias("words"), "f", part.alias("part"))

    itself = F.array(row(F.col("words"), part))
    flow = F.array(row(F.regexp_extract("words", r"(?s)^(.*) [^ ]*$", 1), F.lit(True)))
    both = F.when(F.col("f") >= least, F.concat(itself, flow)).otherwise(flow)
    return F.when(flows, both).otherwise(itself)


def collocations(
    documents: DataFrame,
    max_words: int = MAX_WORDS,
    least: int = LEAST_COUNT,
    absorbed: int = ABSORBED,
    top: int = TOP,
) -> DataFrame:
    """``lang, rank, phrase, a, l, r, n, score``: the first ``top`` phrases of each language.

    Text is lower-cased (A-Z), cut into pieces at marks and line ends and into words at
    spaces and tabs.  Null text is empty, a null language is ``und``; repeated rows count
    as often as they occur; other columns are not read.  Ties in score go to the more
    frequent phrase, then to the smaller one by its bytes.  Without text there is no row.
    """
    spark = documents.sparkSession
    path = new_path(spark)
    counts = kept(gram_counts(documents, max_words, least), path=path)
    phrases = counts.where("k >= 2").select("lang", "phrase", "k", F.col("f").alias("a"))
    cuts = phrases.select("*", F.explode(F.sequence(F.lit(1), F.col("k").cast("int") - 1)).alias("cut")).withColumns({
        "head": F.expr("substring_index(phrase, ' ', cut)"), "rest": F.expr("substring_index(phrase, ' ', cut - cast(k AS int))"),
    })
    part = counts.where("k >= 1")
    cuts = cuts.join(part.select("lang", F.col("phrase").alias("head"), F.col("f").alias("l")), ["lang", "head"])
    cuts = cuts.join(part.select("lang", F.col("phrase").alias("rest"), F.col("f").alias("r")), ["lang", "rest"])
    # 38 digits hold a million squares of counts up to 10^16
    wide = "cast(cast(a AS decimal(16,0)) * cast(a AS decimal(16,0)) AS decimal(32,0)) * cast(1000000 AS decimal(7,0))"
    score = F.expr(f"cast(({wide}) div (cast(l AS decimal(19,0)) * cast(r AS decimal(19,0))) AS bigint)")
    lowest = cuts.withColumn("score", score).groupBy("lang", "phrase", "k", "a").agg(F.min(F.struct("score", "cut", "l", "r")).alias("low"))
    # what lies inside a longer phrase lies inside one that is longer by a word and no rarer
    inside = F.array(F.expr("substring_index(phrase, ' ', cast(k AS int) - 1)"), F.expr("substring_index(phrase, ' ', 1 - cast(k AS int))"))
    longer = phrases.where("k > 2").select("lang", F.explode(inside).alias("phrase"), F.col("a").alias("longer"))
    longer = longer.groupBy("lang", "phrase").agg(F.max("longer").alias("longer"))
    stays = F.coalesce(100 * F.col("longer") < absorbed * F.col("a"), F.lit(True))
    left = lowest.join(longer, ["lang", "phrase"], "left").where(stays).select("lang", "phrase", "a", "low.l", "low.r", "low.score")
    order = [F.col("score").desc(), F.col("a").desc(), F.col("phrase")]
    first = first_rows(left, ["lang"], order, top)
    words = counts.where("k = 0").select("lang", F.col("f").alias("n"))
    return first.join(words, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")


def op11_collocations(spark: SparkSession, folder: str) -> DataFrame:
    """The collocations of each language in all ``documents``."""
    return collocations(spark.read.parquet(f"{folder}/documents.parquet"))


OP11_SQL = rf"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang,
         unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                      '[.,;:!?\x0A-\x0D]')) AS piece
  FROM documents
),
tokens AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM pieces),
placed AS (SELECT lang, w, unnest(range(1, len(w) + 1)) AS i FROM tokens),
grams AS (
  SELECT lang, k, array_to_string(w[i:i + k - 1], ' ') AS phrase, count(*) AS f
  FROM placed, (SELECT unnest([1, 2, 3]) AS k) WHERE i + k - 1 <= len(w) GROUP BY ALL
),
totals AS (SELECT lang, CAST(sum(f) AS BIGINT) AS n FROM grams WHERE k = 1 GROUP BY lang),
candidates AS (SELECT * FROM grams WHERE k >= 2 AND f >= {LEAST_COUNT}),
cuts AS (
  SELECT lang, phrase, f AS a, cut,
         array_to_string(string_split(phrase, ' ')[:cut], ' ') AS head, array_to_string(string_split(phrase, ' ')[cut + 1:], ' ') AS rest
  FROM candidates, (SELECT unnest([1, 2]) AS cut) WHERE cut < k
),
scored AS (
  SELECT c.lang, c.phrase, c.a, c.cut, h.f AS l, t.f AS r,
         CAST(CAST(c.a AS HUGEINT) * c.a * 1000000 // (CAST(h.f AS HUGEINT) * t.f) AS BIGINT) AS score
  FROM cuts c JOIN grams h ON h.lang = c.lang AND h.phrase = c.head JOIN grams t ON t.lang = c.lang AND t.phrase = c.rest
),
lowest AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) = 1),
longer AS (
  SELECT lang, part AS phrase, max(f) AS longer FROM (
    SELECT lang, f, unnest([array_to_string(string_split(phrase, ' ')[:2], ' '), array_to_string(string_split(phrase, ' ')[2:], ' ')]) AS part
    FROM candidates WHERE k = 3) GROUP BY ALL
)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score
FROM lowest LEFT JOIN longer USING (lang, phrase) JOIN totals USING (lang)
WHERE longer IS NULL OR 100 * longer < {ABSORBED} * a
QUALIFY rank <= {TOP}
"""
