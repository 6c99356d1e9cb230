"""Readers of annotated corpora, mail archives and news files.

Annotated text becomes token rows ``(doc_id, sent_id, pos, token, tag[, iob,
chunk])``; ``pos`` counts from 0. Malformed rows don't stop the reading: their
``_error`` says what is wrong, and ``mode="FAILFAST"`` raises instead.
"""

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import tags as T
from ..functions import text as X


def tagged_words(line, tagset: T.TagSet = T.RAW) -> Column:
    """``array<struct<token, tag>>`` of ``token/TAG`` words.

    The last slash divides; a word without one has the unknown tag.
    """

    def read(w: Column) -> Column:
        slash = w.contains("/")
        token = F.when(slash, F.regexp_extract(w, r"^(.*)/([^/]*)$", 1)).otherwise(w)
        tag = F.when(slash, T.parse_tag(F.regexp_extract(w, r"^(.*)/([^/]*)$", 2), tagset)).otherwise(F.lit(T.UNKNOWN))
        return F.struct(token.alias("token"), tag.alias("tag"))

    return F.transform(X.words(line), read)


def long_form(df: DataFrame, tagged: str = "tagged", *keys: str) -> DataFrame:
    """One row per token of a tagged-sentence column."""
    return df.select(*(keys or [c for c in df.columns if c != tagged]), F.posexplode(tagged).alias("pos", "_t")).select("*", "_t.token", "_t.tag").drop("_t")


def array_form(tokens: DataFrame, *keys: str) -> DataFrame:
    """The inverse: tagged sentences, in the order of ``pos``."""
    t = F.sort_array(F.collect_list(F.struct("pos", "token", "tag")))
    return tokens.groupBy(*keys).agg(F.transform(t, lambda x: F.struct(x["token"].alias("token"), x["tag"].alias("tag"))).alias("tagged"))


def lines(df: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """``(key, line_no, line)`` of each text."""
    return df.select(key, F.posexplode(F.split(text, "\n")).alias("line_no", "line"))


def read_tagged(df: DataFrame, tagset: T.TagSet = T.RAW, text: str = "text", key: str = "doc_id") -> DataFrame:
    """Token rows of texts with one sentence of ``token/TAG`` words per line; blank lines are empty sentences."""
    rows = lines(df, text, key).select(key, F.col("line_no").alias("sent_id"), tagged_words("line", tagset).alias("tagged"))
    return long_form(rows, "tagged", key, "sent_id")


def iob_fields(line, tagset: T.TagSet = T.RAW) -> Column:
    """Struct ``token, tag, iob, chunk, _error`` of an IOB line ``token TAG B-X``; more words are ignored."""
    w = X.words(line)
    label = F.get(w, F.lit(2))
    marked = label.startswith("I-") | label.startswith("B-")
    chunk = F.when(marked, T.parse_chunk(F.substring(label, 3, 1 << 30), tagset))
    error = F.when(F.size(w) < 3, F.concat(F.lit("fewer than three words: "), X._c(line))).when(marked & chunk.isNull(), F.concat(F.lit("unknown chunk: "), label))
    ok = error.isNull()
    return F.struct(
        F.get(w, F.lit(0)).alias("token"),
        F.when(F.size(w) >= 2, T.parse_tag(F.get(w, F.lit(1)), tagset)).alias("tag"),
        F.when(ok, F.when(marked, F.left(label, F.lit(1))).otherwise(F.lit("O"))).alias("iob"),
        F.when(ok, chunk).alias("chunk"),
        error.alias("_error"),
    )


def sentence_lines(df: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """``(key, sent_id, pos, line)``: stripped lines in blocks that blank lines divide."""
    rows = lines(df, text, key).withColumn("line", F.trim(F.regexp_replace("line", r"^\s+|\s+$", "")))
    order = Window.partitionBy(key).orderBy("line_no")
    blank = (F.col("line") == "").cast("int")
    begins = F.when((F.col("line") != "") & (F.coalesce(F.lag("line").over(order), F.lit("")) == ""), 1).otherwise(0)
    rows = rows.withColumn("_b", begins).withColumn("_z", blank).withColumn("sent_id", F.sum("_b").over(order) - 1).filter("_z = 0")
    return rows.select(key, F.col("sent_id").cast("int"), (F.row_number().over(Window.partitionBy(key, "sent_id").orderBy("line_no")) - 1).alias("pos"), "line")


def read_iob(df: DataFrame, tagset: T.TagSet = T.RAW, text: str = "text", key: str = "doc_id", mode: str = "PERMISSIVE") -> DataFrame:
    """Token rows of IOB texts, a token per line and a blank line between sentences."""
    rows = sentence_lines(df, text, key).select(key, "sent_id", "pos", iob_fields("line", tagset).alias("f")).select(key, "sent_id", "pos", "f.*")
    if mode.upper() == "FAILFAST":
        rows = rows.withColumn("_error", F.when(F.col("_error").isNotNull(), F.raise_error(F.col("_error"))).cast("string"))
    return rows


def sentence_results(iob_rows: DataFrame, *keys: str) -> DataFrame:
    """``(keys, tokens, error)``: all entries of each sentence, or of each whole text if ``keys`` name that, or else the first error in it."""
    order = [c for c in ("sent_id", "pos") if c not in keys]
    entry = F.struct(*order, "token", "tag", "iob", "chunk")
    first = F.min(F.when(F.col("_error").isNotNull(), F.struct(*order, "_error")))["_error"]
    rows = iob_rows.groupBy(*keys).agg(F.sort_array(F.collect_list(entry)).alias("tokens"), first.alias("error"))
    return rows.withColumn("tokens", F.when(F.col("error").isNull(), F.col("tokens")))


def tagged_sentences(iob_rows: DataFrame) -> DataFrame:
    """Drops the chunk layer of IOB rows, and malformed rows."""
    return iob_rows.filter(F.col("_error").isNull()).drop("iob", "chunk", "_error")


def iob_words(line) -> Column:
    """The IOB lines of a line of ``token|TAG|IOB`` words."""
    return F.transform(X.words(line), lambda w: F.translate(w, "|", " "))


def read_wikiner(df: DataFrame, tagset: T.TagSet = T.WIKINER, text: str = "text", key: str = "doc_id") -> DataFrame:
    """Token rows of texts with one sentence of ``token|TAG|IOB`` words per line; empty lines are no sentences."""
    rows = lines(df, text, key).withColumn("_w", iob_words("line")).filter(F.size("_w") > 0)
    rows = rows.select(key, F.col("line_no").alias("sent_id"), F.posexplode("_w").alias("pos", "_l"))
    return rows.select(key, "sent_id", "pos", iob_fields("_l", tagset).alias("f")).select(key, "sent_id", "pos", "f.*")


def read_latin1(spark: SparkSession, path: str, glob: str = "*") -> DataFrame:
    """``(file, text)`` of files in Latin 1."""
    return spark.read.format("binaryFile").option("pathGlobFilter", glob).load(path).select(F.col("path").alias("file"), F.decode("content", "ISO-8859-1").alias("text"))


def mail_messages(texts: DataFrame, text: str = "text", key: str = "file") -> DataFrame:
    """``(key, msg_id, body)`` of mbox texts: a message begins at a ``From `` line, its body after the first blank line."""
    parts = F.filter(F.split(F.concat(F.lit("\n"), F.regexp_replace(text, "\r\n", "\n")), r"\n(?=From )"), lambda p: p.startswith("From "))
    rows = texts.select(key, F.posexplode(parts).alias("msg_id", "_m"))
    body = F.when(F.instr("_m", "\n\n") > 0, F.expr("substring(_m, instr(_m, '\n\n') + 2)")).otherwise(F.lit(""))
    return rows.select(key, "msg_id", body.alias("body"))


def read_mbox(spark: SparkSession, path: str) -> DataFrame:
    """``(file, msg_id, body)`` of all ``.txt`` archives in a folder."""
    return mail_messages(read_latin1(spark, path, "*.txt"))


def mail_tokens(messages: DataFrame) -> DataFrame:
    return messages.withColumn("tokens", X.tokenize("body"))


def news_documents(texts: DataFrame, text: str = "text", marker: str = "DEV-MUC3-") -> DataFrame:
    """``(doc_id, site, text)`` of files whose documents begin with a marker line such as ``DEV-MUC3-0001 (SITE)``."""
    parts = F.split(F.concat(F.lit("\n"), F.col(text)), rf"\n(?={marker})")
    rows = texts.select(F.explode(parts).alias("_d")).filter(F.col("_d").startswith(marker))
    site = F.nullif(F.regexp_extract("_d", r"^\S+\s*\(([^)]*)\)", 1), F.lit(""))
    return rows.select(F.regexp_extract("_d", r"^(\S+)", 1).alias("doc_id"), site.alias("site"), F.regexp_replace("_d", r"^[^\n]*\n?", "").alias("text"))


def read_news(spark: SparkSession, path: str, marker: str = "DEV-MUC3-") -> DataFrame:
    return news_documents(spark.read.text(path, wholetext=True).withColumnRenamed("value", "text"), "text", marker)


def read_text(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """``(doc_id, text)``, a row per file, so that no line joins two files."""
    return spark.read.text(paths, wholetext=True).select(F.input_file_name().alias("doc_id"), F.col("value").alias("text"))
