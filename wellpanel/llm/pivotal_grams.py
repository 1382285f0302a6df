"""Spelling variants: words one edit apart, found by pivotal bigrams.

Bigrams have one order, by the number of words that hold them.  A word's gram prefix is its first three bigrams in
that order, with all occurrences of the third; one edit can touch one of two disjoint bigrams only, so of two near
words the one whose prefix ends earlier has a pivot that stands unharmed in the prefix of the other.  Two disjoint
pivots are chosen inside the prefix by dynamic programming, for the shortest expected lists.

Position limits: an edit behind the left pivot leaves everything up to and with it in place, and any other edit
leaves everything from the right pivot on in place, counted from the end.  So the left pivot is looked up with the
whole start of the word, the right one with its whole end, both at lengths that differ by at most one.  What meets
is verified by its edit distance inside the join.

Words are counted with map-side aggregation; what reaches the driver is the bigram table, bounded by the alphabet
(26 + 64 letters, hence at most 8,100 rows).
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from wellpanel.llm.storage import staged, table

LETTERS = r"A-Za-zÀ-ÿ"
LEAST_LENGTH, LEAST_COUNT, RATIO, NOISE = 7, 2, 10, 31
GRAM, EDITS = 2, 1
PREFIX = GRAM * EDITS + 1
#: Each form occurs at least RATIO times as often as its word, so a chain of forms has fewer links than a long has digits.
DOUBLINGS = 5
INDEX = "pivot boolean, left boolean, part string, length int, word string, n long, letters long"


def word_counts(docs: DataFrame, least_length: int = LEAST_LENGTH, noise: int = NOISE) -> DataFrame:
    """``(word, n)`` of the letter runs of all texts, A-Z lower-cased, after the planted deletions.

    A run loses its code point ``h % length`` where ``noise`` divides ``h``, the crc32 of ``<doc_id>:<run>`` (a null
    id reads "null").  Runs shorter than ``least_length`` cannot become words, so they are never made into rows.
    """
    runs = docs.select(
        F.coalesce(F.col("doc_id").cast("string"), F.lit("null")).alias("id"),
        F.explode(F.regexp_extract_all(F.col("text").cast("string"), F.lit(f"([{LETTERS}]{{{least_length},}})"), F.lit(1))).alias("run"),
    ).select("id", F.translate("run", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz").alias("run"))
    hashed = runs.select("run", F.crc32(F.concat("id", F.lit(":"), "run").cast("binary")).alias("h"))
    at = (F.col("h") % F.length("run")).cast("int")
    cut = F.concat(F.col("run").substr(F.lit(1), at), F.col("run").substr(at + 2, F.length("run")))
    words = hashed.select(F.when(F.col("h") % noise == 0, cut).otherwise(F.col("run")).alias("word"))
    return words.filter(F.length("word") >= least_length).groupBy("word").agg(F.count("*").alias("n"))


def gram_counts(words: DataFrame) -> dict[str, int]:
    """How often each bigram stands in the distinct words."""
    grams = words.select(F.explode(F.transform(F.sequence(F.lit(1), F.length("word") - GRAM + 1), lambda k: F.col("word").substr(k, F.lit(GRAM)))).alias("gram"))
    return {r.gram: r.n for r in grams.groupBy("gram").agg(F.count("*").alias("n")).collect()}


def letter_counts(grams: dict[str, int]) -> dict[str, int]:
    found: Counter = Counter()
    for gram, n in grams.items():
        found[gram[0]] += n
        found[gram[-1]] += n
    return found


def gram_prefix(word: str, grams: dict[str, int]) -> list[int]:
    """Positions of the first ``PREFIX`` bigrams in the common order, with all that equal the last of them."""
    order = sorted((grams[word[i : i + GRAM]], word[i : i + GRAM], i) for i in range(len(word) - GRAM + 1))
    last = order[min(PREFIX, len(order)) - 1][:2]
    return sorted(i for n, gram, i in order if (n, gram) <= last)


def pivots(word: str, prefix: list[int], grams: dict[str, int], letters: dict[str, int]) -> tuple[int, int]:
    """Two disjoint positions of the prefix with the least expected lists, by dynamic programming over positions.

    A list's expected length is the share of words with the same start (or end), taken as a chain of bigrams.
    """
    m = len(word) - GRAM + 1
    shares = [math.log(grams[word[i : i + GRAM]]) for i in range(m)]
    links = [math.log(letters[c]) for c in word]
    left, right, total = [0.0] * m, [0.0] * m, 0.0
    for i in range(m):
        total += shares[i] - (links[i] if i else 0.0)
        left[i] = math.exp(total)
    total = 0.0
    for i in range(m - 1, -1, -1):
        total += shares[i] - (links[i + 1] if i < m - 1 else 0.0)
        right[i] = math.exp(total)
    best, chosen, opened, first = math.inf, (prefix[0], prefix[-1]), math.inf, prefix[0]
    behind = 0
    for second in prefix:
        while prefix[behind] + GRAM <= second:  # the cheapest left pivot that ends before this one
            if left[prefix[behind]] < opened:
                opened, first = left[prefix[behind]], prefix[behind]
            behind += 1
        if opened + right[second] < best:
            best, chosen = opened + right[second], (first, second)
    return chosen


def parity(word: str) -> int:
    """Bit sets of letters that occur an odd number of times; one edit flips at most two of them."""
    bits = 0
    for c in word:
        bits ^= 1 << (ord(c) & 63)
    return bits - (1 << 64) if bits >> 63 else bits


def _indexer(grams: dict[str, int], letters: dict[str, int]):
    def index(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for word, n in zip(batch["word"].tolist(), batch["n"].tolist()):
                size, bits, prefix = len(word), parity(word), gram_prefix(word, grams)
                first, second = pivots(word, prefix, grams, letters)
                for length in (size - 1, size, size + 1):  # lengths that a near word may have
                    rows.append((True, True, word[: first + GRAM], length, word, n, bits))
                    rows.append((True, False, word[second:], length, word, n, bits))
                for at in prefix:
                    rows.append((False, True, word[: at + GRAM], size, word, n, bits))
                    rows.append((False, False, word[at:], size, word, n, bits))
            yield pd.DataFrame(rows, columns=["pivot", "left", "part", "length", "word", "n", "letters"])

    return index


def near_words(words: DataFrame) -> DataFrame:
    """``(word, near, near_n)``: each pair of ``words(word, n)`` that differ by one edit, in both directions, once.

    Words must have at least four code points, so that a prefix holds two disjoint bigrams.
    """
    grams = gram_counts(words)
    index = staged(words.mapInPandas(_indexer(grams, letter_counts(grams)), INDEX), "pivotal-grams")
    asked = index.filter("pivot").select("left", "part", "length", "word", "n", "letters")
    listed = index.filter("not pivot").select("left", "part", "length", F.col("word").alias("near"), F.col("n").alias("near_n"), F.col("letters").alias("near_letters"))
    alike = (
        (F.bit_count(F.col("letters").bitwiseXOR(F.col("near_letters"))) <= 2 * EDITS)
        & (F.col("word") != F.col("near"))
        & (F.levenshtein("word", "near", EDITS) == EDITS)
    )
    same = [asked[c] == listed[c] for c in ("left", "part", "length")]
    pairs = asked.join(listed.hint("merge"), [*same, alike]).select("word", "n", "near", "near_n")
    both = pairs.select("word", "near", "near_n").unionAll(pairs.select(F.col("near").alias("word"), F.col("word").alias("near"), F.col("n").alias("near_n")))
    return both.repartition("word").dropDuplicates(["word", "near"])


def _roots(forms: DataFrame) -> DataFrame:
    """``(word, root)`` for ``forms(word, form)``: forms followed to the last one, in steps that double."""
    current = staged(forms.select("word", F.col("form").alias("root")), "roots")
    for _ in range(DOUBLINGS):
        further = current.select(F.col("word").alias("root"), F.col("root").alias("beyond"))
        stepped = staged(current.join(further, "root", "left").select("word", F.coalesce("beyond", "root").alias("root"), F.col("beyond").isNotNull().alias("moved")), "roots")
        current = stepped.select("word", "root")
        if stepped.filter("moved").isEmpty():
            break
    return current


def spelling_variants(docs: DataFrame, least_count: int = LEAST_COUNT, ratio: int = RATIO) -> DataFrame:
    """``(word, form, root, n, n_near, form_n)`` for every word of ``docs(doc_id, text)``.

    Null and letterless texts give no words; a null id hashes as "null"; repeated rows count again; ties of the
    largest n go to the smaller word; other columns are ignored.  An empty table gives an empty result.
    """
    words = staged(word_counts(docs).filter(F.col("n") >= least_count), "words")
    ranked = near_words(words).select(
        "word", "near", "near_n", F.row_number().over(Window.partitionBy("word").orderBy(F.desc("near_n"), "near")).alias("rank"),
    )
    found = ranked.groupBy("word").agg(F.count("*").alias("n_near"), F.max("near_n").alias("most"), F.max(F.when(F.col("rank") == 1, F.col("near"))).alias("best"))
    enough = F.col("most") >= ratio * F.col("n")
    marked = staged(
        words.join(found, "word", "left").select(
            "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
            F.when(enough, F.col("best")).alias("form"), F.when(enough, F.col("most")).alias("form_n"),
        ),
        "forms",
    )
    roots = _roots(marked.filter("form is not null"))
    return marked.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def op11_pivotal_grams(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling_variants(table(spark, sf_dir, "documents"))


SQL = f"""
WITH RECURSIVE crc AS (SELECT list_transform(range(256), lambda i: list_reduce(list_prepend(i, range(8)),
    lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS t),
runs AS (SELECT doc_id, regexp_extract_all(text, '[A-Za-zÀ-ÿ]+') AS found FROM documents),
lowered AS (SELECT coalesce(doc_id::VARCHAR, 'null') AS id, translate(run, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run, count(*) AS times
  FROM (SELECT doc_id, unnest(found) AS run FROM runs) WHERE length(run) >= {LEAST_LENGTH} GROUP BY ALL),
hashed AS (SELECT run, times, xor(list_reduce(list_prepend(4294967295, flatten(list_transform(string_split(id || ':' || run, ''),
    lambda c: CASE WHEN ord(c) < 128 THEN [ord(c)::BIGINT] ELSE [(192 | (ord(c) >> 6))::BIGINT, (128 | (ord(c) & 63))::BIGINT] END))),
    lambda a, b: xor(a >> 8, t[(xor(a, b) & 255) + 1])), 4294967295) AS h FROM lowered, crc),
named AS (SELECT CASE WHEN h % {NOISE} = 0 THEN left(run, (h % length(run))::INT) || substr(run, (h % length(run))::INT + 2) ELSE run END AS word, times FROM hashed),
words AS MATERIALIZED (SELECT word, sum(times)::BIGINT AS n FROM named WHERE length(word) >= {LEAST_LENGTH} GROUP BY word HAVING sum(times) >= {LEAST_COUNT}),
cuts AS MATERIALIZED (SELECT word, n, k, left(word, k - 1) || substr(word, k + 1) AS cut FROM (SELECT *, unnest(range(1, length(word) + 1))::INT AS k FROM words)),
near AS (SELECT a.word, b.word AS near, b.n FROM cuts a JOIN cuts b ON a.cut = b.cut AND a.k = b.k AND a.word <> b.word
  UNION SELECT a.word, b.word, b.n FROM cuts a JOIN words b ON a.cut = b.word
  UNION SELECT b.word, a.word, a.n FROM cuts a JOIN words b ON a.cut = b.word),
best AS (SELECT word, count(*) AS n_near, max(n) AS most, first(near ORDER BY n DESC, encode(near)) AS best FROM near GROUP BY word),
forms AS MATERIALIZED (SELECT w.word, CASE WHEN most >= {RATIO} * w.n THEN best END AS form, w.n, coalesce(n_near, 0)::BIGINT AS n_near,
  CASE WHEN most >= {RATIO} * w.n THEN most END AS form_n FROM words w LEFT JOIN best USING (word)),
steps AS (SELECT word, word AS root, 0 AS hop FROM forms
  UNION ALL SELECT s.word, f.form, s.hop + 1 FROM steps s JOIN forms f ON s.root = f.word WHERE f.form IS NOT NULL)
SELECT f.word, f.form, s.root, f.n, f.n_near, f.form_n FROM forms f JOIN (SELECT word, arg_max(root, hop) AS root FROM steps GROUP BY word) s USING (word)
"""
