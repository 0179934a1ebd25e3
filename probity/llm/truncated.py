"""Text cut off by field limits (problem 8), in SQL.

Every text is read as tokens: words, numbers, single Han characters, tags, punctuation. All word trigrams of
the corpus are counted, inside texts and at their ends, once as written and once by the classes of their
tokens (the backoff for trigrams that are too rare to tell). A text is a candidate if its last trigram is
frequent inside texts and almost never ends one: it stops where texts go on. What is put at a cut (an
ellipsis in brackets, a hyphen, broken characters) is taken off before.

Trigrams are counted by their hashes, two BIGINTs for the words and the classes.

Then the candidates are checked: a short text without any sentence mark is a heading unless its last word is
no whole word of the corpus but the start of one, or its length lies at a limit of its source, or its recorded length is more than
it can have; a text that ends with an ellipsis counts only if its length lies at a limit of its
source and the source often ends its texts so there, or if the word before it is none of the corpus but the start of one. A limit is a length, in characters or bytes, at which a source has far more texts than just below it.
A text that ends inside a tag or
address or just after an opening tag is always cut.

Defined cases: null, empty and blank texts are never cut; repeated texts are judged like single ones; null
sources are one source of their own; an empty table gives an empty result. Whole texts are read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.session import cut, table
from ..functions.skew import lookup

#: A source's name without case, outer blanks, hyphens or inner blanks.
SOURCE = r"regexp_replace(lower(trim(source)), '[\\s\\-]+', '_')"

#: The ranges of Han characters. Ranges are told from letters faster than the script's name.
_HAN = r"\\u2E80-\\u2FDF\\u3005\\u3007\\u3021-\\u3029\\u3038-\\u303B\\u3400-\\u4DBF\\u4E00-\\u9FFF\\uF900-\\uFAFF\\x{{20000}}-\\x{{3FFFF}}"
_LETTER = rf"[\\pL\\pM&&[^{_HAN}]]"
_TOKEN = rf"{_LETTER}+(?:[\\x27’]{_LETTER}+)*|</?[\\pL][^<>]*>|<[^<>]*$|\\pN+|\\.\\.\\.|[^\\s]"
#: Signs that are a class each; with the other classes there are fewer than 40, so fewer than 64,000 trigrams of classes.
_SIGNS = ", ".join(f"'{x}'" for x in ",;:-–—([«“„/=°%&*+@#<|~_")
_CLASS = rf"""CASE WHEN x rlike '^{_LETTER}' THEN 'w' WHEN x IN ('.', '!', '?', '。', '！', '？', '؟', '।') THEN 's' WHEN x rlike '^[{_HAN}]' THEN 'h' WHEN x rlike '^\\pN' THEN 'n'
    WHEN x IN ('…', '...') THEN 'e' WHEN x rlike '^["”»’)\\]}}}}」』]$' THEN 'q' WHEN x rlike '^</?\\pL.*>$' THEN 't' WHEN x IN ({_SIGNS}) THEN x ELSE 'x' END"""

#: What a system puts where it cut, and blanks; an ellipsis alone may be the author's and stays.
_MARK = r"\\[(?:…|\\.\\.\\.)\\]|�|(?<=[\\pL\\pM\\pN\\s])-"
_BLANK = r"[\\s\\p{{Cf}}]"
_MARKS = rf"(?:{_BLANK}|{_MARK})+$"
_LAST = r"[\\s\\p{{Cf}}\\]�-]"  # what a mark or a blank ends in

#: The beginning of an address that ends like a sentence.
_ADDRESS = r"(?:^|\\s)(?:https?://[^/\\s]*[.]|https?://[^?\\s]*[?]|\\S+@[^.\\s]*[.])$"


def read_texts(documents: DataFrame) -> DataFrame:
    """(doc_id, n_chars, src, key): one row a row whose text is not blank; key is the text's hash."""
    return documents.sparkSession.sql(
        rf"SELECT doc_id, n_chars, coalesce({SOURCE}, '') AS src, unhex(sha2(text, 256)) AS key FROM {{docs}} WHERE text rlike '[^\s]'", docs=documents)


def read_tokens(documents: DataFrame) -> DataFrame:
    """One row a different text that is not blank: its key, its tokens as written (lower case) and by class, its lengths."""
    return documents.sparkSession.sql(
        rf"""
        WITH body AS (
          SELECT unhex(sha2(text, 256)) AS key, text, IF(right(text, 1) rlike '{_LAST}', regexp_replace(text, '{_MARKS}', ''), text) AS body
          FROM (SELECT DISTINCT text FROM {{docs}} WHERE text rlike '[^\s]')),
        tok AS (SELECT *, regexp_extract_all(lower(body), '{_TOKEN}', 0) AS w FROM body)
        SELECT key, w, transform(w, x -> {_CLASS}) AS c,
          char_length(text) AS chars, octet_length(text) AS bytes, contains(body, '<') AND body rlike '<[^<>\s][^<>]*$' AS in_tag, right(text, 1) rlike '{_LAST}' AND text rlike '(?:{_MARK}){_BLANK}*$' AS marked,
          right(body, 1) IN ('.', '?') AND body rlike '{_ADDRESS}' AS in_address, char_length(body) - CASE WHEN endswith(body, '…') THEN 1 WHEN endswith(body, '...') THEN 3 ELSE 0 END AS chars_left
        FROM tok""", docs=documents)


def _trigram(a: str, i: str) -> str:
    """The hash of the trigram that ends at position i of the array a; two marks stand before its first token."""
    return f"xxhash64(coalesce(get({a}, {i} - 2), '^'), coalesce(get({a}, {i} - 1), '^'), get({a}, {i}))"


def trigrams(tokens: DataFrame) -> DataFrame:
    """(tri, tri_c, inside, at_end): the hashes of all trigrams and of their classes, counted inside and at the ends of different texts.

    A trigram has one trigram of classes, so it is counted under its own hash alone.
    """
    return tokens.sparkSession.sql(
        f"""
        SELECT t.w AS tri, max(t.c) AS tri_c, count_if(NOT t.last) AS inside, count_if(t.last) AS at_end FROM (
          SELECT explode(transform(w, (x, i) -> struct({_trigram('w', 'i')} AS w, {_trigram('c', 'i')} AS c, i = size(w) - 1 AS last))) AS t
          FROM {{tok}} WHERE size(w) > 0) GROUP BY 1""", tok=tokens)


def limits(texts: DataFrame, least: int = 4, times: float = 6.0) -> DataFrame:
    """(src, unit, len): lengths at which a source has at least `times` as many texts as just below.

    texts has one row a different text of a source. There must be `least` texts of that length, twice as many if it is below 100.
    """
    return texts.sparkSession.sql(
        """
        WITH len AS (
          SELECT src, 'chars' AS unit, chars AS len, 1 AS weight FROM {texts} UNION ALL SELECT src, 'bytes', bytes, 1 FROM {texts}
          UNION ALL SELECT src, 'left', chars_left, 1 FROM {texts}),
        hist AS (SELECT src, unit, len, sum(weight) AS n FROM len GROUP BY 1, 2, 3),
        near AS (SELECT *, coalesce(sum(n) OVER (PARTITION BY src, unit ORDER BY len RANGE BETWEEN 22 PRECEDING AND 3 PRECEDING), 0) / 20.0D AS below FROM hist)
        SELECT src, unit, len FROM near WHERE n >= if(len < 100, 2 * {least}, {least}) AND len > 24 AND n >= {times} * greatest(below, 0.5D)""",
        texts=texts, least=least, times=times)


def _join_counted(rows: DataFrame, table_: DataFrame, key: str, total: int) -> DataFrame:
    """rows (left) joined with table_ by key, each different key once, keys of many rows apart from the shuffle."""
    return lookup(rows, rows.groupBy(key).agg(F.count("*").alias("_n")).join(table_, key, "left"), key, "_n", total)


def cut_texts(documents: DataFrame, frequent: int = 20, share: float = 0.1, heading: int = 6) -> DataFrame:
    """(doc_id, src, cut, at_limit, ..., rule): all texts that are not blank, whether they lost their end, and by which evidence.

    Copies count once: trigrams are those of the different texts, lengths those of the different texts of a
    source. The verdict is joined back to all rows, of which each has its own recorded length.

    frequent: how often a trigram must occur to be judged as written; share: the largest share of its
    occurrences that may be ends; heading: the most words of a heading.
    """
    spark = documents.sparkSession
    rows, tokens = cut(read_texts(documents)), cut(read_tokens(documents))
    counts = cut(trigrams(tokens))
    by_class = spark.sql("SELECT tri_c, sum(inside) AS ci, sum(at_end) AS ce FROM {n} GROUP BY 1", n=counts)
    by_word = spark.sql("SELECT tri, inside AS wi, at_end AS we FROM {n} WHERE inside + at_end >= {least}", n=counts, least=frequent)
    # the words that something other than an ellipsis follows
    whole = spark.sql("SELECT DISTINCT x AS word FROM (SELECT explode(transform(w, (x, i) -> IF(get(c, i) = 'w' AND get(c, i + 1) <> 'e', x, NULL))) AS x FROM {tok}) WHERE x IS NOT NULL", tok=tokens)
    whole = cut(whole)
    starts = spark.sql("SELECT DISTINCT explode(transform(sequence(1, char_length(word) - 1), i -> substring(word, 1, i))) AS word FROM {whole} WHERE char_length(word) > 1", whole=whole)
    known_words = whole.withColumn("is_word", F.lit(True)).join(starts.withColumn("begins", F.lit(True)), "word", "full")
    homes = rows.select("src", "key").distinct()
    last = cut(spark.sql(
        f"""
        SELECT key, chars, bytes, chars_left, in_tag, marked, in_address, get(w, size(w) - 1) AS last_word, get(c, size(c) - 1) AS last_class,
          {_trigram('w', 'size(w) - 1')} AS tri, {_trigram('c', 'size(w) - 1')} AS tri_c,
          CASE WHEN get(c, size(c) - 1) = 'w' THEN get(w, size(w) - 1) WHEN get(c, size(c) - 1) = 'e' AND get(c, size(c) - 2) = 'w' THEN get(w, size(w) - 2) ELSE '' END AS word,
          NOT exists(slice(c, 1, size(c) - 1), x -> x IN ('s', 'e')) AS one, size(filter(c, x -> x = 'w')) + size(filter(c, x -> x IN ('h', 'n'))) / 2.0D AS words
        FROM {{tok}} WHERE size(w) > 0""", tok=tokens))
    total = last.count()
    known = _join_counted(_join_counted(last, by_word, "tri", total), known_words, "word", total).join(F.broadcast(by_class), "tri_c", "left")
    known = cut(homes.join(known.drop("tri", "tri_c"), "key"))
    seen = cut(limits(known))
    spike = lambda unit, col: seen.where(F.col("unit") == unit).select("src", F.col("len").alias(col), F.lit(True).alias(f"at_{unit}"))
    joined = known.join(spike("chars", "chars"), ["src", "chars"], "left").join(spike("bytes", "bytes"), ["src", "bytes"], "left").join(spike("left", "chars_left"), ["src", "chars_left"], "left")
    judged = cut(spark.sql(
        """
        SELECT *, coalesce(at_chars, false) OR coalesce(at_bytes, false) OR coalesce(at_left, false) AS at_limit,
          CASE WHEN coalesce(wi + we, 0) >= {frequent} THEN we <= {share} * (wi + we) ELSE coalesce(ci, 0) >= {frequent} AND ce <= {share} * (ci + ce) END AS goes_on,
          word <> '' AND is_word IS NULL AS no_word, coalesce(begins, false) AS is_start FROM {joined}""", joined=joined, frequent=frequent, share=share))
    marks = spark.sql("SELECT src, avg(double(last_class = 'e')) >= 0.3 AS marks FROM {judged} WHERE at_limit GROUP BY src", judged=judged)
    return spark.sql(
        """
        SELECT *, CASE WHEN NOT coalesce(cut, false) THEN NULL WHEN in_tag OR in_address OR last_class = 't' THEN 'markup' WHEN last_class = 'e' AND at_limit THEN 'mark at a limit' WHEN goes_on THEN 'trigram'
            WHEN no_word THEN 'word' ELSE 'limit' END AS rule FROM (
          SELECT doc_id, src, last_class, goes_on, at_limit, no_word, is_start, one, words, marked, in_tag, in_address, CASE
            WHEN in_tag OR in_address THEN true
            WHEN last_class = 'e' THEN coalesce(at_limit AND marks, false) OR (no_word AND is_start)
            WHEN last_class = 't' THEN goes_on OR last_word rlike '^<[^/>]([^>]*[^/>])?>$'
            WHEN last_class IN ('s', 'q') THEN false
            WHEN one AND words <= {heading} THEN (no_word AND is_start) OR at_limit OR coalesce(n_chars > bytes + 2, false) OR marked
            ELSE goes_on OR no_word OR at_limit END AS cut
          FROM {rows} JOIN {judged} USING (src, key) LEFT JOIN {marks} USING (src))""", rows=rows, judged=judged, marks=F.broadcast(marks), heading=heading)


def p8_found(spark, sf_dir: str) -> DataFrame:
    return cut_texts(table(spark, sf_dir, "documents")).where("cut").select("doc_id")


def p8_rates(spark, sf_dir: str) -> DataFrame:
    """(source, n_texts, n_cut, share): how often each source cuts its texts."""
    return cut_texts(table(spark, sf_dir, "documents")).groupBy(F.nullif("src", F.lit("")).alias("source")).agg(
        F.count("*").alias("n_texts"), F.count_if("cut").alias("n_cut"), F.round(F.avg(F.col("cut").cast("double")), 6).alias("share"))


def p8_rules(spark, sf_dir: str) -> DataFrame:
    """(rule, n_cut): by which evidence the cut texts were found."""
    return cut_texts(table(spark, sf_dir, "documents")).where("cut").groupBy("rule").agg(F.count("*").alias("n_cut"))
