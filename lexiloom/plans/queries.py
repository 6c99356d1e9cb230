"""The operators as queries over the tables, each with the SQL that must give the same rows.

The tables have no tags, so both sides annotate ``documents`` by the same
rules: sentences, tokens, and a tag from each token's form.
"""

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import maps as M
from ..functions import tags as T
from ..functions import text as X
from ..operators import chunking as K
from ..operators import corpus as C
from ..operators import extraction as E
from ..operators import perceptron as P
from ..operators import taggers as G
from ..operators import vectors as V
from ..operators.sizes import sized
from ..sources import corpora as S
from ..sources.tables import read

QUERIES: dict = {}
SQL: dict[str, str] = {}
PLACE = ("doc_id", "sent_id")

DICTIONARY = [("the", "DT"), ("The", "XX"), ("of", "IN"), ("and", "CC"), ("de", "FW"), ("der", "FW"), ("la", "FW"), ("is", "VBZ"), ("IN", "IN1"), ("in", "IN2")]
PRIOR = [("the", "DT"), ("of", "NN"), ("zz", "Unk")]
WEIGHTS = [
    ("pos=DT", "NP", 1.25), ("pos=NN", "NP", 0.75), ("pos=NN", "VP", 0.125), ("pos=VBD", "VP", 1.5), ("pos=VBG", "VP", 0.625), ("pos=IN", "PP", 1.0), ("pos=.", "O", 2.0),
    ("prevpos=DT", "NP", 0.5), ("prevpos=IN", "NP", 0.375), ("prevpos=VBD", "ADVP", 0.8), ("prevpos+pos=NN+NN", "VP", 0.7), ("pos+nextpos=NN+IN", "ZZ", 0.9), ("word=the", "NP", 0.25), ("since=NN", "VP", 0.333),
]
TAG_WEIGHTS = [("suf=ing", "VBG", 0.9), ("suf=ed", "VBD", 0.4), ("w=the", "DT", 1.5), ("p1w=the", "NN", 0.75), ("n1w=of", "NN", 0.25), ("n1w=of", "JJ", 0.25), ("bias=", "NN", 0.125), ("pre=t", "IN", 0.2), ("p1suf=the", "JJ", 0.7)]


def values(rows: list[tuple], names: str) -> str:
    shown = ", ".join("(" + ", ".join(f"'{v}'" if isinstance(v, str) else f"CAST({v} AS DOUBLE)" for v in r) + ")" for r in rows)
    return f"(SELECT * FROM (VALUES {shown}) AS v({names}))"


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


# ---- the shared annotation

WORDS = r"list_filter(regexp_split_to_array(text, '\s+'), lambda x: x <> '')"
SENTENCES = r"list_filter(list_transform(string_split(regexp_replace(text, '([.!?])\s+', '\1' || chr(10), 'g'), chr(10)), lambda x: trim(x)), lambda x: x <> '')"
TOKENS = r"""list_filter(regexp_split_to_array(regexp_replace(regexp_replace(sentence, '(^|\s)(["(\[{]+)', '\1\2 ', 'g'), '([.,;:!?")\]}]+)(\s|\z)', ' \1\2', 'g'), '\s+'), lambda x: x <> '')"""
TAG = """CASE WHEN right(token, 1) IN ('.', ',') THEN '.' WHEN lower(token) IN ('the', 'an', 'a') THEN 'DT' WHEN lower(token) IN ('of', 'in', 'on', 'for', 'with', 'by') THEN 'IN'
WHEN token LIKE '%ing' THEN 'VBG' WHEN token LIKE '%ed' THEN 'VBD' WHEN token LIKE '%ly' THEN 'RB' ELSE 'NN' END"""
BASE = f"""WITH ss AS (SELECT doc_id, {SENTENCES} AS ss FROM documents),
s AS (SELECT doc_id, unnest(range(len(ss))) AS sent_id, unnest(ss) AS sentence FROM ss),
ts AS (SELECT doc_id, sent_id, {TOKENS} AS ts FROM s),
tok AS (SELECT doc_id, sent_id, unnest(range(len(ts))) AS pos, unnest(ts) AS token FROM ts),
tt AS (SELECT *, {TAG} AS tag FROM tok)"""
PRINTED = f"array_to_string(list_transform(ts, lambda token: token || '/' || {TAG}), ' ')"


def sentence_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.sentence_rows(read(spark, sf_dir, "documents"))


def token_arrays(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentence_rows(spark, sf_dir).select(*PLACE, X.tokenize("sentence").alias("tokens"))


def token_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.token_rows(token_arrays(spark, sf_dir), "tokens", *PLACE)


def form_tag(token: str | Column = "token") -> Column:
    t = F.col(token) if isinstance(token, str) else token
    low = F.lower(t)
    tag = F.when(F.right(t, F.lit(1)).isin(".", ","), ".").when(low.isin("the", "an", "a"), "DT").when(low.isin("of", "in", "on", "for", "with", "by"), "IN")
    return tag.when(t.endswith("ing"), "VBG").when(t.endswith("ed"), "VBD").when(t.endswith("ly"), "RB").otherwise("NN")


def tagged_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_rows(spark, sf_dir).withColumn("tag", form_tag())


def tagged_sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(doc_id, sent_id, tagged)``, without an exchange."""
    tagged = F.transform(X.tokenize("sentence"), lambda t: F.struct(t.alias("token"), form_tag(t).alias("tag")))
    return sentence_rows(spark, sf_dir).select(*PLACE, tagged.alias("tagged"))


def printed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tagged_sentences(spark, sf_dir).select(*PLACE, X.print_tagged("tagged").alias("line"))


def word_docs(spark: SparkSession, sf_dir: str, table: str = "documents", key: str = "doc_id") -> DataFrame:
    return read(spark, sf_dir, table).select(F.col(key).alias("doc_id"), X.words("text").alias("tokens"))


def n_by(df: DataFrame, *keys: str) -> DataFrame:
    return df.groupBy(*keys).agg(F.count("*").alias("n"))


# ---- text

WORD_ROWS = f"WITH w AS (SELECT doc_id, unnest({WORDS}) AS term FROM documents)"


@query("tokens_words", f"SELECT doc_id, CAST(len({WORDS}) AS INTEGER) AS n, array_to_string({WORDS}, ' ') AS words FROM documents")
def _(spark, d):
    return word_docs(spark, d).select("doc_id", F.size("tokens").alias("n"), F.array_join("tokens", " ").alias("words"))


@query("sentences_split", BASE + " SELECT doc_id, CAST(sent_id AS INTEGER) AS sent_id, sentence FROM s")
def _(spark, d):
    return sentence_rows(spark, d)


@query("tokenize", BASE + " SELECT doc_id, CAST(sent_id AS INTEGER) AS sent_id, array_to_string(ts, ' ') AS tokens FROM ts")
def _(spark, d):
    return sentence_rows(spark, d).select(*PLACE, F.array_join(X.tokenize("sentence"), " ").alias("tokens"))


@query("token_suffix_prefix", BASE + " SELECT right(token, 3) AS suffix, left(token, 1) AS prefix, left(token, greatest(length(token) - 1, 0)) AS init, count(*) AS n FROM tok GROUP BY ALL")
def _(spark, d):
    t = token_rows(spark, d).select(X.suffix("token").alias("suffix"), X.prefix("token").alias("prefix"), X.all_but_last("token").alias("init"))
    return n_by(t, "suffix", "prefix", "init")


@query("contains_token", BASE + " SELECT doc_id, CAST(sent_id AS INTEGER) AS sent_id, list_contains(ts, 'the') AS has_token, len(list_filter(ts, lambda x: lower(x) = 'the')) > 0 AS has_word, CAST(len(ts) AS INTEGER) AS n FROM ts")
def _(spark, d):
    t = tagged_sentences(spark, d)
    return t.select(*PLACE, X.contains("tagged", "the").alias("has_token"), F.exists("tagged", lambda x: X.matches(x["token"], "the", False)).alias("has_word"), X.length("tagged").alias("n"))


@query("contains_tag", BASE + f" SELECT doc_id, CAST(sent_id AS INTEGER) AS sent_id, len(list_filter(ts, lambda token: {TAG} = 'VBG')) > 0 AS has_tag FROM ts")
def _(spark, d):
    return tagged_sentences(spark, d).select(*PLACE, X.contains_tag("tagged", "VBG").alias("has_tag"))


@query("print_tagged_sentence", BASE + f" SELECT doc_id, CAST(sent_id AS INTEGER) AS sent_id, {PRINTED} AS line FROM ts")
def _(spark, d):
    return printed(spark, d)


@query("strip_and_apply_tags", BASE + " SELECT doc_id, coalesce(string_agg(token, ' ' ORDER BY sent_id, pos), '') AS tokens, coalesce(string_agg(tag, ' ' ORDER BY sent_id, pos), '') AS tags, count(token) AS n FROM s LEFT JOIN tt USING (doc_id, sent_id) GROUP BY doc_id")
def _(spark, d):
    t = tagged_sentences(spark, d).withColumn("tagged", X.apply_tags(X.strip_tags("tagged"), X.only_tags("tagged")))
    all_ = t.groupBy("doc_id").agg(X.concat_sentences(F.transform(F.sort_array(F.collect_list(F.struct("sent_id", "tagged"))), lambda x: x["tagged"])).alias("t"))
    return all_.select("doc_id", F.array_join(X.strip_tags("t"), " ").alias("tokens"), F.array_join(X.only_tags("t"), " ").alias("tags"), X.length("t").cast("long").alias("n"))


#: Text in runs of word characters and of others; a protected term is one such run, or three.
PROTECTED = r"""WITH r AS (SELECT doc_id, regexp_extract_all(text, '[\p{L}\p{N}_]+|[^\p{L}\p{N}_]+') AS r FROM documents),
u AS (SELECT doc_id, unnest(range(1, len(r) + 1)) AS i, r FROM r),
m AS (SELECT doc_id, i, r[i] AS x, len(r) >= i + 2 AND list_contains(['of the', 'in the', 'est la', 'der die'], lower(r[i] || r[i + 1] || r[i + 2])) AS three, list_contains(['the', 'é', 'ü'], lower(r[i])) AS one FROM u),
k AS (SELECT doc_id, i, x, CASE WHEN three THEN i WHEN lag(three, 1, false) OVER o THEN i - 1 WHEN lag(three, 2, false) OVER o THEN i - 2 WHEN one THEN i END AS head FROM m WINDOW o AS (PARTITION BY doc_id ORDER BY i)),
g AS (SELECT doc_id, i, x, head, sum(CASE WHEN head IS NULL AND i > 1 AND lag(head) OVER o IS NULL THEN 0 WHEN head < i THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id ORDER BY i) AS part FROM k WINDOW o AS (PARTITION BY doc_id ORDER BY i)),
p AS (SELECT doc_id, part, bool_or(head IS NOT NULL) AS own, string_agg(x, '' ORDER BY i) AS sentence FROM g GROUP BY doc_id, part)"""


@query(
    "protect_terms",
    PROTECTED.replace("sum(CASE WHEN head IS NULL AND i > 1 AND lag(head) OVER o IS NULL THEN 0 WHEN head < i THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id ORDER BY i) AS part FROM k WINDOW o AS (PARTITION BY doc_id ORDER BY i)", "sum(new) OVER (PARTITION BY doc_id ORDER BY i) AS part FROM (SELECT *, CASE WHEN head IS NULL AND i > 1 AND lag(head) OVER o IS NULL THEN 0 WHEN head < i THEN 0 ELSE 1 END AS new FROM k WINDOW o AS (PARTITION BY doc_id ORDER BY i))")
    + f", z AS (SELECT doc_id, part, CASE WHEN own THEN [sentence] ELSE {TOKENS} END AS t FROM p), y AS (SELECT doc_id, part, t FROM z WHERE len(t) > 0) SELECT doc_id, coalesce(tokens, '') AS tokens FROM (SELECT doc_id FROM documents) LEFT JOIN (SELECT doc_id, string_agg(array_to_string(t, '|'), '|' ORDER BY part) AS tokens FROM y GROUP BY doc_id) USING (doc_id)",
)
def _(spark, d):
    terms = ["of the", "in the", "est la", "der die", "the", "É", "ü"]
    return read(spark, d, "documents").select("doc_id", F.array_join(X.protect_terms("text", terms, False), "|").alias("tokens"))


# ---- corpus statistics

TF = WORD_ROWS + ", tf AS (SELECT doc_id, term, count(*) AS tf FROM w GROUP BY ALL), df AS (SELECT term, count(*) AS df FROM tf GROUP BY term), n AS (SELECT count(*) AS n FROM documents)"
VEC = TF + ", v AS (SELECT doc_id, term, tf * ln((1.0 + n) / (2.0 + df)) AS weight FROM tf JOIN df USING (term), n)"


def tf_df(spark, d):
    docs = word_docs(spark, d)
    return *C.frequencies(docs), C.document_count(docs)


@query("term_freq", TF + " SELECT doc_id, term, tf FROM tf")
def _(spark, d):
    return tf_df(spark, d)[0]


@query("doc_freq", TF + " SELECT term, df FROM df")
def _(spark, d):
    return C.doc_freq(word_docs(spark, d))


@query("idf", TF + " SELECT term, df, round(ln((1.0 + n) / (2.0 + df)), 6) AS idf FROM df, n")
def _(spark, d):
    return C.idf(*tf_df(spark, d)[1:]).withColumn("idf", F.round("idf", 6))


@query("tf_idf", VEC + " SELECT doc_id, term, round(weight, 6) AS weight FROM v")
def _(spark, d):
    return C.tf_idf(*tf_df(spark, d)).withColumn("weight", F.round("weight", 6))


@query("term_counts", TF + f", b AS (SELECT DISTINCT unnest({WORDS}) AS term FROM benchmark) SELECT term, coalesce(df, 0) AS df FROM b LEFT JOIN df USING (term)")
def _(spark, d):
    asked = word_docs(spark, d, "benchmark", "item_id").select(F.explode("tokens").alias("term")).distinct()
    return C.term_counts(C.doc_freq(word_docs(spark, d)), asked)


ADDED = "SELECT term, CAST(sum(df) AS BIGINT) AS df FROM (SELECT term, df FROM df UNION ALL SELECT term, count(*) FROM b GROUP BY term) GROUP BY term"


@query("corpus_add_documents", TF + f", b AS (SELECT DISTINCT item_id, unnest({WORDS}) AS term FROM benchmark) {ADDED}")
def _(spark, d):
    return C.add_documents(C.doc_freq(word_docs(spark, d)), 0, word_docs(spark, d, "benchmark", "item_id"))[0]


@query("corpus_add_documents_compat", TF + f", b AS (SELECT item_id, unnest({WORDS}) AS term FROM benchmark) {ADDED}")
def _(spark, d):
    return C.add_documents(C.doc_freq(word_docs(spark, d)), 0, word_docs(spark, d, "benchmark", "item_id"), compat=True)[0]


# ---- vectors

BOTH = VEC + f", bt AS (SELECT item_id, term, count(*) AS tf FROM (SELECT item_id, unnest({WORDS}) AS term FROM benchmark) GROUP BY ALL), bv AS (SELECT item_id, term, tf * ln((1.0 + n) / (2.0 + coalesce(df, 0))) AS weight FROM bt LEFT JOIN df USING (term), n)"
PAIRS = BOTH + ", dp AS (SELECT doc_id, item_id, sum(v.weight * bv.weight) AS dot, sum(DISTINCT round(v.weight * bv.weight, 9)) AS once FROM v JOIN bv USING (term) WHERE v.weight <> 0 AND bv.weight <> 0 GROUP BY ALL), vm AS (SELECT doc_id, sqrt(sum(weight * weight)) AS a FROM v GROUP BY doc_id), bm AS (SELECT item_id, sqrt(sum(weight * weight)) AS b FROM bv GROUP BY item_id)"


def two_sides(spark, d, shared: bool = False):
    """The vectors of documents and of benchmark items over the corpus of documents; with ``shared`` the documents' only by the items' terms."""
    tf, df, n = tf_df(spark, d)
    items = C.term_freq(word_docs(spark, d, "benchmark", "item_id"))
    if shared:
        tf = tf.join(sized(items.select("term").distinct()), "term", "left_semi").select("doc_id", "term", "tf")
        df = tf.groupBy("term").agg(F.count("*").alias("df"))
    own = C.tf_idf(tf, df, n).withColumnRenamed("doc_id", "vec_id")
    return own, C.tf_idf(items, df, n).withColumnRenamed("doc_id", "vec_id")


@query("vector_magnitude", VEC + " SELECT doc_id, round(sqrt(sum(weight * weight)), 6) AS magnitude FROM v GROUP BY doc_id")
def _(spark, d):
    return V.magnitude(C.tf_idf(*tf_df(spark, d)), "doc_id").withColumn("magnitude", F.round("magnitude", 6))


@query("dot_product", PAIRS + " SELECT doc_id, item_id, round(dot, 5) AS dot FROM dp")
def _(spark, d):
    return V.dot(*two_sides(spark, d, True), "doc_id", "item_id").withColumn("dot", F.round("dot", 5))


@query("dot_product_compat", PAIRS + " SELECT doc_id, item_id, round(once, 5) AS dot FROM dp")
def _(spark, d):
    return V.dot(*two_sides(spark, d, True), "doc_id", "item_id", compat=True).withColumn("dot", F.round("dot", 5))


@query("cosine_pairs", PAIRS + " SELECT doc_id, item_id, round(coalesce(dot / nullif(a * b, 0), 0), 6) AS cosine FROM dp JOIN vm USING (doc_id) JOIN bm USING (item_id)")
def _(spark, d):
    return V.cosine(*two_sides(spark, d), "doc_id", "item_id").withColumn("cosine", F.round("cosine", 6))


@query("cosine_all_pairs", BOTH + ", bm AS (SELECT item_id, sqrt(sum(weight * weight)) AS m FROM bv GROUP BY item_id), p AS (SELECT x.item_id AS a_id, y.item_id AS b_id, sum(x.weight * y.weight) AS dot FROM bv x JOIN bv y ON x.term = y.term AND x.item_id < y.item_id WHERE x.weight <> 0 AND y.weight <> 0 GROUP BY ALL) SELECT a_id, b_id, round(coalesce(dot / nullif(x.m * y.m, 0), 0), 6) AS cosine FROM p JOIN bm x ON x.item_id = a_id JOIN bm y ON y.item_id = b_id")
def _(spark, d):
    items = two_sides(spark, d, True)[1]
    return V.cosine(items, items, ordered=True).withColumn("cosine", F.round("cosine", 6))


@query("vector_sum", VEC + " SELECT lang, term, round(sum(weight), 5) AS weight FROM v JOIN documents USING (doc_id) GROUP BY ALL")
def _(spark, d):
    v = C.tf_idf(*tf_df(spark, d)).join(read(spark, d, "documents").select("doc_id", "lang"), "doc_id")
    return V.total(v, "lang").withColumn("weight", F.round("weight", 5))


@query("vector_add", BOTH + " SELECT id AS vec_id, term, round(sum(weight), 6) AS weight FROM (SELECT doc_id AS id, term, weight FROM v UNION ALL SELECT item_id, term, weight FROM bv) GROUP BY ALL")
def _(spark, d):
    return V.add(*two_sides(spark, d), "vec_id").withColumn("weight", F.round("weight", 6))


@query("vector_negate", BOTH + " SELECT item_id AS vec_id, term, round(-weight, 6) AS weight FROM bv")
def _(spark, d):
    return V.negate(two_sides(spark, d, True)[1]).withColumn("weight", F.round("weight", 6))


@query(
    "cosine_search",
    VEC + ", m AS (SELECT doc_id, sqrt(sum(weight * weight)) AS m FROM v GROUP BY doc_id), p AS (SELECT x.doc_id AS a_id, y.doc_id AS b_id, sum(x.weight * y.weight) AS dot FROM v x JOIN v y ON x.term = y.term AND x.doc_id % 100 = 0 WHERE x.weight <> 0 AND y.weight <> 0 GROUP BY ALL) SELECT a_id, b_id, round(coalesce(dot / nullif(x.m * y.m, 0), 0), 6) AS cosine FROM p JOIN m x ON x.doc_id = a_id JOIN m y ON y.doc_id = b_id",
)
def _(spark, d):
    """Every document whose id is divisible by 100 against all documents."""
    tf, df, n = tf_df(spark, d)
    own = C.tf_idf(tf, df, n).withColumnRenamed("doc_id", "vec_id")
    return V.cosine(own, own.filter("vec_id % 100 = 0"), "b_id", "a_id").withColumn("cosine", F.round("cosine", 6))


@query(
    "similarity",
    TF + f", bt AS (SELECT item_id, unnest({WORDS}) AS term FROM benchmark), bf AS (SELECT item_id, term, count(*) AS tf FROM bt GROUP BY ALL), ww AS (SELECT item_id, term, tf * ln((1.0 + n) / (2.0 + coalesce(df, 0))) AS weight FROM bf LEFT JOIN df USING (term), n), ax AS (SELECT item_id, unnest(regexp_split_to_array(upper(replace(text, 'ß', 'SS')) || ' ' || text, '\\s+')) AS term FROM benchmark), af AS (SELECT item_id, term, count(*) AS tf FROM ax WHERE term <> '' GROUP BY ALL), aw AS (SELECT item_id, term, tf * ln((1.0 + n) / (2.0 + coalesce(df, 0))) AS weight FROM af LEFT JOIN df USING (term), n), dt AS (SELECT item_id, sum(ww.weight * aw.weight) AS dot FROM ww JOIN aw USING (item_id, term) GROUP BY item_id), ma AS (SELECT item_id, sqrt(sum(weight * weight)) AS a FROM ww GROUP BY item_id), mb AS (SELECT item_id, sqrt(sum(weight * weight)) AS b FROM aw GROUP BY item_id) SELECT item_id AS pair_id, round(coalesce(dot / nullif(a * b, 0), 0), 6) AS similarity FROM benchmark LEFT JOIN dt USING (item_id) LEFT JOIN ma USING (item_id) LEFT JOIN mb USING (item_id)",
)
def _(spark, d):
    """Each benchmark text beside itself with an upper-case copy, over the corpus of documents."""
    pairs = read(spark, d, "benchmark").select(F.col("item_id").alias("pair_id"), F.col("text").alias("a"), F.concat_ws(" ", F.upper("text"), "text").alias("b"))
    return V.similarity(pairs, word_docs(spark, d)).withColumn("similarity", F.round("similarity", 6))


@query("vector_lookup", BOTH + ", k AS (SELECT DISTINCT term FROM bv) SELECT doc_id AS vec_id, count(*) AS n_keys, round(coalesce(max(CASE WHEN term = 'the' THEN weight END), 0), 6) AS the FROM v GROUP BY doc_id")
def _(spark, d):
    v = C.tf_idf(*tf_df(spark, d)).withColumnRenamed("doc_id", "vec_id")
    v = V.add(v, V.zero(v), "vec_id")  # the zero vector changes nothing
    return v.groupBy("vec_id").agg(F.count("*").alias("n_keys"), F.round(F.coalesce(F.max(F.when(F.col("term") == "the", F.col("weight"))), F.lit(0.0)), 6).alias("the"))


LANGS = "WITH a AS (SELECT source, lang, count(*) AS n FROM documents GROUP BY ALL), b AS (SELECT source, lang, max(n_chars) AS m FROM documents WHERE n_chars > 2000 GROUP BY ALL)"


def source_maps(spark, d) -> DataFrame:
    """Per source, its documents by language, and its longest long document by language."""
    docs = read(spark, d, "documents")

    def gathered(df, name):
        rows = df.groupBy("source").agg(F.sort_array(F.collect_list(F.struct(F.col("lang").alias("key"), F.col("v").alias("value")))).alias("_e"))
        return rows.select("source", M.from_entries("_e").alias(name))

    a = gathered(docs.groupBy("source", "lang").agg(F.count("*").alias("v")), "a")
    b = gathered(docs.filter("n_chars > 2000").groupBy("source", "lang").agg(F.max("n_chars").alias("v")), "b")
    return a.join(b, "source", "left").withColumn("b", F.coalesce("b", M.empty("string", "bigint")))


@query("default_map_lookup", LANGS + " SELECT source, coalesce(max(CASE WHEN lang = 'es' THEN n END), -1) AS es, CAST(coalesce(max(CASE WHEN lang = 'xx' THEN n END), -7) AS INTEGER) AS xx, count(*) AS n_keys, CAST(sum(n) AS BIGINT) AS total FROM a GROUP BY source")
def _(spark, d):
    m = source_maps(spark, d)
    return m.select("source", M.lookup("a", "es", -1).alias("es"), M.lookup("a", "xx", -7).cast("int").alias("xx"), F.size(M.keys("a")).cast("long").alias("n_keys"), M.fold("a", F.lit(0).cast("long"), lambda s, v: s + v).alias("total"))


@query("default_map_union_with", LANGS + " SELECT source, lang, coalesce(n, 1) * coalesce(m, 10) AS value FROM a FULL JOIN b USING (source, lang)")
def _(spark, d):
    m = source_maps(spark, d).select("source", M.union_with("a", "b", lambda x, y: x * y, 1, 10).alias("u"))
    return m.select("source", F.explode("u").alias("lang", "value"))


@query("default_map_values", LANGS + " SELECT source, lang, n * 3 AS value FROM a")
def _(spark, d):
    m = source_maps(spark, d).select("source", M.map_values("a", lambda v: v * 3).alias("u"))
    return m.select("source", F.explode("u").alias("lang", "value"))


# ---- corpora

READ = r"regexp_extract(w, '^(.*)/([^/]*)$', 1) AS token, regexp_extract(w, '^(.*)/([^/]*)$', 2) AS tag"


@query("read_tagged", BASE + " SELECT doc_id, CAST(sent_id AS INTEGER) AS sent_id, CAST(pos AS INTEGER) AS pos, token, tag FROM tt")
def _(spark, d):
    """Printed sentences read back."""
    lines = printed(spark, d).select(*PLACE, S.tagged_words("line", T.CONLL).alias("tagged"))
    return S.long_form(lines, "tagged", *PLACE)


@query(
    "read_tagged_multi_slash",
    WORD_ROWS.replace("AS term", "|| '/x/' || lang AS w") + rf" SELECT token, tag, count(*) AS n FROM (SELECT {READ} FROM w UNION ALL SELECT 'bare', 'Unk' FROM documents) GROUP BY ALL",
)
def _(spark, d):
    docs = read(spark, d, "documents")
    line = F.array_join(F.transform(X.words("text"), lambda w: F.concat(w, F.lit("/x/"), F.col("lang"))), " ")
    both = docs.select("doc_id", F.concat(line, F.lit("\nbare")).alias("text"))
    return n_by(S.read_tagged(both), "token", "tag")


IOB = BASE + ", io AS (SELECT *, CASE WHEN tag = '.' THEN 'O' WHEN tag = 'DT' THEN 'B-NP' WHEN tag IN ('NN', 'RB') THEN 'I-NP' WHEN tag = 'IN' THEN 'B-PP' WHEN tag = 'VBG' THEN 'B-ZZ' ELSE 'I-VP' END AS label FROM tt)"


def iob_label() -> Column:
    t = F.col("tag")
    return F.when(t == ".", "O").when(t == "DT", "B-NP").when(t.isin("NN", "RB"), "I-NP").when(t == "IN", "B-PP").when(t == "VBG", "B-ZZ").otherwise("I-VP")


def iob_texts(spark, d) -> DataFrame:
    """One text per document: IOB lines with blank lines between sentences."""
    word = F.concat_ws(" ", "token", "tag", iob_label())
    sort = lambda o, c, by: F.array_join(F.transform(F.sort_array(F.collect_list(F.struct(by, c.alias("w")))), lambda x: x["w"]), o)
    return tagged_rows(spark, d).groupBy(*PLACE).agg(sort("\n", word, "pos").alias("l")).groupBy("doc_id").agg(sort("\n \n", F.col("l"), "sent_id").alias("text"))


IOB_ROWS = IOB + """, ir AS (SELECT doc_id, dense_rank() OVER (PARTITION BY doc_id ORDER BY sent_id) - 1 AS sent_id, pos, token, tag, CASE WHEN label = 'B-ZZ' THEN NULL ELSE left(label, 1) END AS iob,
CASE WHEN label IN ('B-ZZ', 'O') THEN NULL ELSE substring(label, 3) END AS chunk, label = 'B-ZZ' AS bad FROM io)"""


@query("parse_iob_lines", IOB_ROWS + " SELECT doc_id, CAST(sent_id AS BIGINT) AS sent_id, CAST(pos AS BIGINT) AS pos, token, tag, iob, chunk, bad FROM ir")
def _(spark, d):
    r = S.read_iob(iob_texts(spark, d), T.CONLL)
    return r.select("doc_id", F.col("sent_id").cast("long"), F.col("pos").cast("long"), "token", "tag", "iob", "chunk", F.col("_error").isNotNull().alias("bad"))


@query("tagged_sentences", IOB_ROWS + " SELECT tag, token, count(*) AS n FROM ir WHERE NOT bad GROUP BY ALL")
def _(spark, d):
    return n_by(S.tagged_sentences(S.read_iob(iob_texts(spark, d), T.CONLL)), "tag", "token")


@query("get_sentences", IOB + " SELECT doc_id, count(DISTINCT sent_id) AS sentences, count(*) AS n_lines FROM io GROUP BY doc_id")
def _(spark, d):
    return S.sentence_lines(iob_texts(spark, d)).groupBy("doc_id").agg(F.countDistinct("sent_id").alias("sentences"), F.count("*").alias("n_lines"))


#: Entity labels by tag, one of them none of the set's.
ENTITY = "CASE tag WHEN 'NN' THEN 'I-PER' WHEN 'DT' THEN 'B-LOC' WHEN 'IN' THEN 'B-ORG' WHEN 'VBG' THEN 'I-MISC' WHEN 'RB' THEN 'B-NP' ELSE 'O' END"


def entity_label() -> Column:
    label = F.lit("O")
    for tag, own in (("NN", "I-PER"), ("DT", "B-LOC"), ("IN", "B-ORG"), ("VBG", "I-MISC"), ("RB", "B-NP")):
        label = F.when(F.col("tag") == tag, own).otherwise(label)
    return label


@query(
    "parse_wikiner",
    BASE
    + f""", l AS (SELECT doc_id, list_filter(string_split(token || '|' || tag || '|' || {ENTITY}, '|'), lambda x: x <> '') AS l FROM tt),
e AS (SELECT doc_id, l[1] AS token, l[2] AS tag, l[3] AS label, len(l) < 3 AS few, regexp_matches(l[3], '^[BI]-') AS marked, substring(l[3], 3) IN ('PER', 'ORG', 'LOC', 'MISC') AS good FROM l),
b AS (SELECT *, few OR (marked AND NOT good) AS bad FROM e)
SELECT doc_id, token, tag, CASE WHEN NOT bad THEN CASE WHEN marked THEN left(label, 1) ELSE 'O' END END AS iob, CASE WHEN NOT bad AND marked THEN substring(label, 3) END AS chunk, bad, count(*) AS n FROM b GROUP BY ALL""",
)
def _(spark, d):
    """Words read back with entity labels; a bar of a token's own divides it."""
    word = F.concat_ws("|", "token", "tag", entity_label())
    lines = tagged_rows(spark, d).groupBy(*PLACE).agg(F.array_join(F.collect_list(word), " ").alias("l")).groupBy("doc_id").agg(F.array_join(F.collect_list("l"), "\n\n").alias("text"))
    rows = S.read_wikiner(lines).withColumn("bad", F.col("_error").isNotNull())
    return n_by(rows, "doc_id", "token", "tag", "iob", "chunk", "bad")


@query("entity_codec", BASE + f" SELECT label, CASE WHEN label IN ('PER', 'ORG', 'LOC', 'MISC') THEN label END AS entity, count(*) AS n FROM (SELECT substring({ENTITY}, 3) AS label FROM tt) GROUP BY ALL")
def _(spark, d):
    label = tagged_rows(spark, d).select(F.substring(entity_label(), 3, 9).alias("label"))
    return n_by(label.select("label", T.parse_entity("label").alias("entity")), "label", "entity")


@query(
    "iob_sentence_results",
    IOB_ROWS + ", f AS (SELECT doc_id, sent_id, count(*) AS n, min(CASE WHEN bad THEN pos END) AS first_bad FROM ir GROUP BY doc_id, sent_id) SELECT doc_id, CAST(sent_id AS BIGINT) AS sent_id, CAST(CASE WHEN first_bad IS NULL THEN n END AS INTEGER) AS n, CASE WHEN first_bad IS NOT NULL THEN 'unknown chunk: B-ZZ' END AS error FROM f",
)
def _(spark, d):
    """All entries of a sentence or an error."""
    r = S.sentence_results(S.read_iob(iob_texts(spark, d), T.CONLL), *PLACE)
    return r.select("doc_id", F.col("sent_id").cast("long"), F.when(F.col("tokens").isNotNull(), F.size("tokens")).alias("n"), "error")


@query("iob_corpus_results", IOB_ROWS + " SELECT doc_id, CASE WHEN bool_or(bad) THEN NULL ELSE CAST(count(*) AS INTEGER) END AS n, CASE WHEN bool_or(bad) THEN 'unknown chunk: B-ZZ' END AS error FROM ir GROUP BY doc_id")
def _(spark, d):
    """All entries of a corpus, here a document, or an error."""
    r = S.sentence_results(S.read_iob(iob_texts(spark, d), T.CONLL), "doc_id")
    return r.select("doc_id", F.when(F.col("tokens").isNotNull(), F.size("tokens")).alias("n"), "error")


@query("news_documents", "SELECT 'NEWS-' || doc_id AS doc_id, upper(source) AS site, text FROM documents")
def _(spark, d):
    """Documents written as news files, one a source, and read back."""
    head = F.concat(F.lit("NEWS-"), F.col("doc_id").cast("string"), F.lit(" ("), F.upper("source"), F.lit(")\n"))
    files = read(spark, d, "documents").groupBy("source").agg(F.array_join(F.collect_list(F.concat(head, "text")), "\n").alias("text"))
    return S.news_documents(files, marker="NEWS-")


def codec_sql(s: T.TagSet, norm: str) -> str:
    tags, marks = (", ".join("'" + t.replace("'", "''") + "'" for t in sorted(x)) for x in (s.tags, s.marks))
    return f"SELECT term, CASE WHEN term IN ({marks}) THEN term WHEN {norm} IN ({tags}) AND length(replace(term, '(', '')) = length(replace(term, ')', '')) THEN {norm} ELSE 'Unk' END AS tag FROM (SELECT DISTINCT term FROM w UNION SELECT DISTINCT upper(replace(left(term, 2), 'ß', 'SS')) FROM w UNION SELECT DISTINCT right(term, 1) FROM w)"


def codec(s: T.TagSet):
    def run(spark, d):
        w = C.term_rows(word_docs(spark, d)).select("term")
        some = w.union(w.select(F.upper(F.left("term", F.lit(2))))).union(w.select(F.right("term", F.lit(1)))).distinct()
        return some.select("term", T.parse_tag("term", s).alias("tag"))

    return run


INNER = r"upper(regexp_replace(term, '^[\s(]+|[\s)]+$', '', 'g'))"
query("tag_codec_conll", WORD_ROWS + codec_sql(T.CONLL, INNER))(codec(T.CONLL))
query("tag_codec_brown", WORD_ROWS + codec_sql(T.BROWN, f"translate({INNER}, '_', '-')"))(codec(T.BROWN))


@query("chunk_codec", IOB + " SELECT substring(label, 3) AS label, CASE WHEN substring(label, 3) IN ('NP', 'PP', 'VP') THEN substring(label, 3) END AS conll, CASE WHEN substring(label, 3) IN ('NP', 'PP', 'VP') THEN 'C_' || substring(label, 3) END AS brown, count(*) AS n FROM io WHERE label <> 'O' GROUP BY ALL")
def _(spark, d):
    r = tagged_rows(spark, d).withColumn("label", iob_label()).filter("label <> 'O'").withColumn("label", F.substring("label", 3, 9))
    return n_by(r.select("label", T.parse_chunk("label", T.CONLL).alias("conll"), T.parse_chunk("label", T.BROWN).alias("brown")), "label", "conll", "brown")


# ---- taggers


def dictionary(spark) -> DataFrame:
    return spark.createDataFrame(DICTIONARY, "term string, tag string")


@query("literal_tag", BASE + f" SELECT token, coalesce(v.tag, 'Unk') AS tag, count(*) AS n FROM tok LEFT JOIN {values(DICTIONARY, 'term, tag')} v ON term = token GROUP BY ALL")
def _(spark, d):
    return n_by(G.dictionary_tags(token_rows(spark, d), dictionary(spark)), "token", "tag")


@query("literal_tag_ci", BASE + f", v AS (SELECT lower(term) AS term, arg_max(tag, term) AS tag FROM {values(DICTIONARY, 'term, tag')} GROUP BY lower(term)) SELECT token, coalesce(v.tag, 'Unk') AS tag, count(*) AS n FROM tok LEFT JOIN v ON term = lower(token) GROUP BY ALL")
def _(spark, d):
    return n_by(G.dictionary_tags(token_rows(spark, d), dictionary(spark), False), "token", "tag")


#: A second opinion on each token's tag, so that some tokens are ambiguous.
DOUBTED = BASE + ", dt AS (SELECT *, CASE WHEN token = 'for' AND sent_id % 2 = 0 THEN 'CS' WHEN tag = 'NN' AND length(token) = 3 AND doc_id % 2 = 0 THEN 'NNP' ELSE tag END AS gold FROM tt)"


def doubted(spark, d) -> DataFrame:
    t = tagged_rows(spark, d)
    gold = F.when((F.col("token") == "for") & (F.col("sent_id") % 2 == 0), "CS").when((F.col("tag") == "NN") & (F.length("token") == 3) & (F.col("doc_id") % 2 == 0), "NNP").otherwise(F.col("tag"))
    return t.withColumn("gold", gold)


AMBIGUOUS = "CASE WHEN min(tag) = max(tag) THEN min(tag) ELSE 'Unk' END AS tag"


@query("unambiguous_train", DOUBTED + f" SELECT token AS term, {AMBIGUOUS.replace('tag)', 'gold)')} FROM dt GROUP BY token")
def _(spark, d):
    return G.unambiguous(doubted(spark, d).select("token", F.col("gold").alias("tag")))


@query("unambiguous_retrain", DOUBTED + f" SELECT term, {AMBIGUOUS} FROM (SELECT token AS term, gold AS tag FROM dt UNION ALL SELECT term, tag FROM {values(PRIOR, 'term, tag')}) GROUP BY term")
def _(spark, d):
    return G.unambiguous(doubted(spark, d).select("token", F.col("gold").alias("tag")), spark.createDataFrame(PRIOR, "term string, tag string"))


COMBINED = DOUBTED + f", cb AS (SELECT dt.*, coalesce(v.tag, dt.tag) AS pred FROM dt LEFT JOIN {values(DICTIONARY, 'term, tag')} v ON term = token)"


@query("backoff_combine", COMBINED + " SELECT token, pred AS tag, count(*) AS n FROM cb GROUP BY ALL")
def _(spark, d):
    """The dictionary's tags, and the form's where it has none."""
    known = F.create_map(*[F.lit(x) for row in DICTIONARY for x in row])
    first = F.transform("tagged", lambda t: F.struct(t["token"].alias("token"), F.coalesce(F.try_element_at(known, t["token"]), F.lit("Unk")).alias("tag")))
    both = tagged_sentences(spark, d).select(*PLACE, X.combine(first, "tagged").alias("tagged"))
    return n_by(S.long_form(both, "tagged", *PLACE), "token", "tag")


@query("literal_transform", COMBINED + " SELECT doc_id, token, coalesce(w.tag, 'Unk') AS tag, count(*) AS n FROM cb LEFT JOIN " + values(DICTIONARY, "term, tag") + " w ON w.term = token GROUP BY ALL")
def _(spark, d):
    tagger = G.LiteralTagger(dictionary(spark))
    return n_by(S.long_form(tagger.transform(token_arrays(spark, d)).select(*PLACE, "tagged"), "tagged", *PLACE), "doc_id", "token", "tag")


SECOND = [("is", "AUX"), ("la", "XX"), ("une", "DT"), ("das", "DT"), ("est", "VB")]
STACKED = BASE + f", st AS (SELECT doc_id, sent_id, pos, token, tt.tag AS gold, coalesce(a.tag, b.tag, 'Unk') AS tag, coalesce(a.tag, 'Unk') AS first FROM tt LEFT JOIN {values(DICTIONARY, 'term, tag')} a ON a.term = token LEFT JOIN {values(SECOND, 'term, tag')} b ON b.term = token)"


def stacked(spark) -> G.Tagger:
    return G.LiteralTagger(dictionary(spark), backoff=G.LiteralTagger(spark.createDataFrame(SECOND, "term string, tag string")))


@query("tag_text", STACKED + ", sl AS (SELECT doc_id, sent_id, string_agg(token || '/' || tag, ' ' ORDER BY pos) AS l FROM st GROUP BY doc_id, sent_id) SELECT doc_id, string_agg(coalesce(l, ''), ' ' ORDER BY sent_id) AS text FROM s LEFT JOIN sl USING (doc_id, sent_id) GROUP BY doc_id")
def _(spark, d):
    return stacked(spark).tag_text(read(spark, d, "documents"))


@query("tagger_evaluate", STACKED + " SELECT round(avg(CAST(tag = gold AS INTEGER)), 6) AS accuracy, count(*) AS n_tokens, true AS backoff FROM st UNION ALL SELECT round(avg(CAST(first = gold AS INTEGER)), 6), count(*), false FROM st")
def _(spark, d):
    gold, tagger = tagged_sentences(spark, d), stacked(spark)
    both = tagger.evaluate(gold).withColumn("backoff", F.lit(True)).unionByName(tagger.evaluate(gold, use_backoff=False).withColumn("backoff", F.lit(False)))
    return both.withColumn("accuracy", F.round("accuracy", 6))


@query("train_unambiguous", DOUBTED + f" SELECT token AS term, {AMBIGUOUS.replace('tag)', 'gold)')} FROM dt GROUP BY token")
def _(spark, d):
    """The first tagger of an untrained stack after its training."""
    tagged = F.sort_array(F.collect_list(F.struct("pos", "token", F.col("gold").alias("tag"))))
    rows = doubted(spark, d).groupBy(*PLACE).agg(F.transform(tagged, lambda x: F.struct(x["token"].alias("token"), x["tag"].alias("tag"))).alias("tagged"))
    empty = spark.createDataFrame([], "term string, tag string")
    return G.UnambiguousTagger(empty).fit(rows).table


@query("tagger_eval", COMBINED + " SELECT round(avg(CAST(pred = gold AS INTEGER)), 6) AS accuracy, count(*) AS n_tokens FROM cb")
def _(spark, d):
    gold = doubted(spark, d)
    first = G.dictionary_tags(gold.drop("tag"), dictionary(spark)).withColumnRenamed("tag", "_d")
    pred = first.withColumn("tag", F.when(F.col("_d") != "Unk", F.col("_d")).otherwise(form_tag()))
    return G.accuracy(pred, gold.select(*PLACE, "pos", F.col("gold").alias("tag")), *PLACE, "pos").withColumn("accuracy", F.round("accuracy", 6))


NEAR = """, nb AS (SELECT doc_id, sent_id, pos, token,
coalesce(lag(token, 1) OVER o, '-START-') AS p1, coalesce(lag(token, 2) OVER o, CASE WHEN pos = 1 THEN '-START2-' ELSE '-START-' END) AS p2_,
coalesce(lead(token, 1) OVER o, '-END-') AS n1, coalesce(lead(token, 2) OVER o, CASE WHEN lead(token, 1) OVER o IS NULL THEN '-END2-' ELSE '-END-' END) AS n2 FROM tok WINDOW o AS (PARTITION BY doc_id, sent_id ORDER BY pos)),
na AS (SELECT doc_id, sent_id, pos, token, CASE WHEN pos = 0 THEN '-START2-' ELSE p1 END AS p1, CASE WHEN pos = 0 THEN '-START-' ELSE p2_ END AS p2, n1, n2 FROM nb),
nf AS (SELECT doc_id, sent_id, pos, unnest(['bias=', 'suf=' || right(token, 3), 'pre=' || left(token, 1), 'w=' || token, 'p1w=' || p1, 'p1suf=' || right(p1, 3), 'p2w=' || p2, 'n1w=' || n1, 'n1suf=' || right(n1, 3), 'n2w=' || n2]) AS feature FROM na)"""


@query("pos_static_features", BASE + NEAR + " SELECT feature, count(*) AS n FROM nf GROUP BY feature")
def _(spark, d):
    return n_by(G.sentence_features(token_arrays(spark, d), *PLACE), "feature")


@query(
    "perceptron_predict",
    BASE + NEAR + f", sc AS (SELECT doc_id, sent_id, pos, class, sum(weight) AS score FROM nf JOIN {values(TAG_WEIGHTS, 'feature, class, weight')} USING (feature) GROUP BY ALL), b AS (SELECT doc_id, sent_id, pos, class, row_number() OVER (PARTITION BY doc_id, sent_id, pos ORDER BY round(score, 6) DESC, class) AS r FROM sc) SELECT token, class, count(*) AS n FROM b JOIN tok USING (doc_id, sent_id, pos) WHERE r = 1 GROUP BY ALL",
)
def _(spark, d):
    sentences = token_arrays(spark, d).repartition(*PLACE)  # the only exchange of tokens
    features = G.sentence_features(sentences, *PLACE, with_token=True)
    return n_by(P.predict(features, spark.createDataFrame(TAG_WEIGHTS, P.WEIGHTS), *PLACE, "pos", "token"), "token", "class")


STATE_SQL = TF + ", st AS (SELECT term AS feature, 'C' || CAST(df % 3 AS VARCHAR) AS class, CAST(df % 11 - 5 AS DOUBLE) AS weight, df * 1.5 AS total, df % 17 AS tstamp FROM df)"


@query("perceptron_average", STATE_SQL + " SELECT * FROM (SELECT feature, class, round_even((total + (1000 - tstamp) * weight) / 1000.0 * 1000, 0) / 1000 AS weight FROM st) WHERE weight <> 0")
def _(spark, d):
    df = F.col("df")
    state = C.doc_freq(word_docs(spark, d)).select(F.col("term").alias("feature"), F.concat(F.lit("C"), df % 3).alias("class"), (df % 11 - 5).cast("double").alias("weight"), (df * 1.5).alias("total"), (df % 17).alias("tstamp"))
    return P.averaged(state, 1000)


#: The best class of one place, with what the tags before add.
BEST = """list_sort(list_transform(x.s || CASE WHEN a.p = 'NN' AND a.q = 'DT' THEN [{'c': 'VBZ', 's': CAST(0.25 AS DOUBLE)}] ELSE [] END,
lambda y: {'k': -round(y.s + CASE WHEN y.c = 'NN' AND a.p = 'DT' THEN 0.5 ELSE 0 END, 6), 'c': y.c}))[1].c"""
HISTORY = [("p1t=DT", "NN", 0.5), ("p12t=NN DT", "VBZ", 0.25)]
#: A fold over each sentence: the scores without history are lists, the state has the two tags before and the tags so far.
DECODED = BASE + NEAR + f""", sc AS (SELECT doc_id, sent_id, pos, class, sum(weight) AS score FROM nf JOIN {values(TAG_WEIGHTS, 'feature, class, weight')} USING (feature) GROUP BY ALL),
ls AS (SELECT doc_id, sent_id, pos, list({{'c': class, 's': score}}) AS s FROM sc GROUP BY doc_id, sent_id, pos),
sn AS (SELECT doc_id, sent_id, list({{'t': '', 'p': '', 'q': '', 's': s}} ORDER BY pos) AS xs FROM ls GROUP BY doc_id, sent_id),
fd AS (SELECT doc_id, sent_id, list_reduce(list_prepend({{'t': '', 'p': '-START-', 'q': '-START2-', 's': xs[1].s}}, xs), lambda a, x:
struct_pack(t := a.t || ' ' || {BEST}, p := {BEST}, q := a.p, s := x.s)) AS r FROM sn),
tg AS (SELECT doc_id, sent_id, string_split(substring(r.t, 2), ' ') AS tags FROM fd)"""


@query("pos_tag_perceptron", DECODED + " SELECT doc_id, CAST(sent_id AS INTEGER) AS sent_id, coalesce(array_to_string(list_transform(list_zip(ts, tags), lambda x: x[1] || '/' || x[2]), ' '), '') AS line FROM ts LEFT JOIN tg USING (doc_id, sent_id)")
def _(spark, d):
    tagger = G.PerceptronTagger(spark.createDataFrame(TAG_WEIGHTS + HISTORY, P.WEIGHTS))
    return tagger.tag(read(spark, d, "documents")).select(*PLACE, X.print_tagged("tagged").alias("line"))


@query("train_tagger_stack")
def _(spark, d):
    """The stack trained on the benchmark's sentences, its dictionary and its weights."""
    rows = G.sentence_rows(read(spark, d, "benchmark"), key="item_id")
    tagged = F.transform(X.tokenize("sentence"), lambda t: F.struct(t.alias("token"), form_tag(t).alias("tag")))
    stack = G.new_tagger(spark, seed=1).fit(rows.select("item_id", "sent_id", tagged.alias("tagged")))
    table = stack.table.select(F.col("term").alias("feature"), F.col("tag").alias("class"), F.lit(1.0).alias("weight"))
    return table.unionByName(stack.backoff.weights)


# ---- chunks

#: Tags back to the last determiner; the set's marks of a sentence's start and end.
CHUNK = BASE + """, ld AS (SELECT *, coalesce(max(CASE WHEN tag = 'DT' THEN pos END) OVER (PARTITION BY doc_id, sent_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), -1) AS ldt FROM tt),
sd AS (SELECT *, coalesce(array_to_string(list_reverse(list(tag) OVER (PARTITION BY doc_id, sent_id, ldt ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)), '-'), '') AS since FROM ld),
cn AS (SELECT *, coalesce(lag(tag) OVER o, 'START') AS p, coalesce(lead(tag) OVER o, 'END') AS n FROM sd WINDOW o AS (PARTITION BY doc_id, sent_id ORDER BY pos)),
cf AS (SELECT doc_id, sent_id, pos, unnest(['pos=' || tag, 'word=' || token, 'prevpos=' || p, 'prevpos+pos=' || p || '+' || tag, 'pos+nextpos=' || tag || '+' || n, 'since=' || since]) AS feature FROM cn)"""
CHUNKED = CHUNK + f""", sc AS (SELECT doc_id, sent_id, pos, class, sum(weight) AS score FROM cf JOIN {values(WEIGHTS, 'feature, class, weight')} USING (feature) GROUP BY ALL),
bs AS (SELECT doc_id, sent_id, pos, arg_min(class, (-round(score, 6), class)) AS class FROM sc GROUP BY ALL),
ck AS (SELECT tt.*, CASE WHEN class IN ('NP', 'VP', 'PP', 'ADVP') THEN class ELSE 'O' END AS chunk FROM tt LEFT JOIN bs USING (doc_id, sent_id, pos)),
nw AS (SELECT *, CASE WHEN chunk <> 'O' AND coalesce(lag(chunk) OVER (PARTITION BY doc_id, sent_id ORDER BY pos), 'O') <> chunk THEN 1 ELSE 0 END AS new FROM ck),
il AS (SELECT *, CASE WHEN chunk <> 'O' THEN sum(new) OVER (PARTITION BY doc_id, sent_id ORDER BY pos) END AS chunk_id FROM nw)"""


def chunk_weights(spark) -> DataFrame:
    return spark.createDataFrame(WEIGHTS, P.WEIGHTS)


def chunked(spark, d) -> DataFrame:
    """``(doc_id, sent_id, chunked)`` of sentences with tokens, without an exchange."""
    return K.Chunker(chunk_weights(spark), T.CONLL).transform_column(tagged_sentences(spark, d).filter(F.size("tagged") > 0)).select(*PLACE, "chunked")


@query("tags_since_dt", CHUNK + " SELECT since, count(*) AS n FROM sd GROUP BY since")
def _(spark, d):
    return n_by(K.tags_since_determiner(tagged_rows(spark, d), *PLACE).select(F.col("tags_since_dt").alias("since")), "since")


@query("chunk_features", CHUNK + " SELECT feature, count(*) AS n FROM cf GROUP BY feature")
def _(spark, d):
    return n_by(K.features(tagged_rows(spark, d), *PLACE, tagset=T.CONLL), "feature")


@query("chunk_predict", CHUNKED + " SELECT token, tag, chunk, count(*) AS n FROM ck GROUP BY ALL")
def _(spark, d):
    return n_by(chunked(spark, d).select(F.explode("chunked").alias("t")).select("t.token", "t.tag", "t.chunk"), "token", "tag", "chunk")


@query("chunk_tree", CHUNKED + " SELECT doc_id, CAST(sent_id AS INTEGER) AS sent_id, CAST(chunk_id AS INTEGER) AS node_id, any_value(chunk) AS label, CAST(min(pos) AS INTEGER) AS start, CAST(max(pos) + 1 AS INTEGER) AS stop FROM il WHERE chunk_id IS NOT NULL GROUP BY doc_id, sent_id, chunk_id")
def _(spark, d):
    return chunked(spark, d).select(*PLACE, F.explode(K.column_spans()(F.col("chunked"))).alias("s")).select(*PLACE, "s.*")


@query(
    "chunk_brackets",
    CHUNKED + ", g AS (SELECT doc_id, sent_id, coalesce(chunk_id, -pos - 1) AS g, min(pos) AS pos, any_value(chunk) AS c, string_agg(token || '/' || tag, ' ' ORDER BY pos) AS t FROM il GROUP BY ALL) SELECT doc_id, CAST(sent_id AS INTEGER) AS sent_id, string_agg(CASE WHEN g > 0 THEN '[' || c || ' ' || t || ']' ELSE t END, ' ' ORDER BY pos) AS text FROM g GROUP BY doc_id, sent_id",
)
def _(spark, d):
    return chunked(spark, d).select(*PLACE, K.column_brackets()(F.col("chunked")).alias("text"))


IOB_CHUNKS = IOB_ROWS.replace("'B-ZZ' ELSE", "'B-VP' ELSE") + """, hd AS (SELECT *, iob = 'B' OR (iob = 'I' AND coalesce(lag(iob) OVER (PARTITION BY doc_id, sent_id ORDER BY pos), 'O') = 'O') AS head FROM ir),
ci AS (SELECT *, CASE WHEN iob <> 'O' THEN sum(CAST(head AS INTEGER)) OVER (PARTITION BY doc_id, sent_id ORDER BY pos) END AS chunk_id FROM hd),
fc AS (SELECT *, CASE WHEN chunk_id IS NULL THEN 'O' ELSE first_value(chunk) OVER (PARTITION BY doc_id, sent_id, chunk_id ORDER BY pos) END AS type FROM ci)"""


def iob_rows(spark, d) -> DataFrame:
    """IOB rows made in place, with a label of the set for that which is none."""
    rows = tagged_rows(spark, d).withColumn("_l", F.replace(iob_label(), F.lit("ZZ"), F.lit("VP")))
    return rows.withColumn("iob", F.left("_l", F.lit(1))).withColumn("chunk", F.when(F.col("_l") != "O", F.substring("_l", 3, 9))).drop("_l")


@query("iob_to_chunks", IOB_CHUNKS + " SELECT type AS label, len, count(*) AS n FROM (SELECT doc_id, sent_id, chunk_id, any_value(type) AS type, count(*) AS len FROM fc WHERE chunk_id IS NOT NULL GROUP BY ALL) GROUP BY ALL")
def _(spark, d):
    c = K.iob_chunks(iob_rows(spark, d), *PLACE).filter("chunk_id IS NOT NULL")
    return n_by(c.groupBy(*PLACE, "chunk_id").agg(F.first("chunk").alias("label"), F.count("*").alias("len")), "label", "len")


@query("iob_to_chunks_compat", IOB_CHUNKS + " SELECT token, type AS chunk, count(*) AS n FROM fc WHERE NOT head GROUP BY ALL")
def _(spark, d):
    return n_by(K.iob_chunks(iob_rows(spark, d), *PLACE, compat=True), "token", "chunk")


@query("innermost_labels", IOB_CHUNKS + " SELECT tag, type AS chunk, count(*) AS n FROM fc GROUP BY ALL")
def _(spark, d):
    rows = iob_rows(spark, d)
    spans = K.spans(K.iob_chunks(rows, *PLACE), *PLACE)
    return n_by(K.innermost(rows.drop("iob", "chunk"), spans, *PLACE), "tag", "chunk")


@query(
    "noun_phrases",
    BASE + ", f AS (SELECT *, tag IN ('NN', 'DT', 'AT', 'JJ') AS np FROM tt), g AS (SELECT *, pos - row_number() OVER (PARTITION BY doc_id, sent_id, np ORDER BY pos) AS k FROM f) SELECT doc_id, CAST(sent_id AS INTEGER) AS sent_id, CAST(min(pos) AS INTEGER) AS start, CAST(max(pos) + 1 AS INTEGER) AS stop, 'C_NP' AS label FROM g WHERE np GROUP BY doc_id, sent_id, k",
)
def _(spark, d):
    return K.noun_phrases(tagged_rows(spark, d), *PLACE)


@query("chunk_text", CHUNKED.replace("tt AS (SELECT *, " + TAG + " AS tag FROM tok)", f"tt AS (SELECT tok.*, coalesce(v.tag, 'Unk') AS tag FROM tok LEFT JOIN {values(DICTIONARY, 'term, tag')} v ON term = token)") + ", g AS (SELECT doc_id, sent_id, coalesce(chunk_id, -pos - 1) AS g, min(pos) AS pos, any_value(chunk) AS c, string_agg(token || '/' || tag, ' ' ORDER BY pos) AS t FROM il GROUP BY ALL), b AS (SELECT doc_id, sent_id, string_agg(CASE WHEN g > 0 THEN '[' || c || ' ' || t || ']' ELSE t END, ' ' ORDER BY pos) AS text FROM g GROUP BY doc_id, sent_id) SELECT doc_id, string_agg(text, ' ' ORDER BY sent_id) AS text FROM b GROUP BY doc_id")
def _(spark, d):
    """Texts tagged by a dictionary and chunked."""
    return K.Chunker(chunk_weights(spark), T.CONLL).chunk_text(G.LiteralTagger(dictionary(spark)), read(spark, d, "documents"))


@query(
    "nested_brackets",
    BASE + ", w AS (SELECT doc_id, sent_id, list_transform(ts, lambda token: token || '/' || " + TAG + ") AS w FROM ts WHERE len(ts) >= 3) SELECT doc_id, CAST(sent_id AS INTEGER) AS sent_id, '[C_CL [C_NP ' || w[1] || '] [C_VP ' || w[2] || ' [C_NP ' || array_to_string(w[3:], ' ') || ']]]' AS text FROM w UNION ALL SELECT doc_id, CAST(sent_id AS INTEGER), '[C_CL ' || array_to_string(list_transform(ts, lambda token: token || '/' || " + TAG + "), ' ') || ']' FROM ts WHERE len(ts) IN (1, 2) UNION ALL SELECT doc_id, CAST(sent_id AS INTEGER), '[C_CL]' FROM ts WHERE len(ts) = 0",
)
def _(spark, d):
    """A clause over each sentence, with a noun phrase and a verb phrase that has a noun phrase within."""
    t = tagged_sentences(spark, d).withColumn("n", F.size("tagged"))
    span = lambda i, parent, depth, label, a, b: F.struct(F.lit(i).alias("node_id"), F.lit(parent).cast("int").alias("parent_id"), F.lit(depth).alias("depth"), F.lit(label).alias("label"), F.lit(a).alias("start"), (F.lit(b) if isinstance(b, int) else b).alias("stop"))
    n = F.col("n")
    root = span(0, None, 0, "C_CL", 0, n)
    spans = F.when(n >= 3, F.array(root, span(1, 0, 1, "C_NP", 0, 1), span(2, 0, 1, "C_VP", 1, n), span(3, 2, 2, "C_NP", 2, n))).otherwise(F.array(root))
    return t.select(*PLACE, K.nested_brackets()(F.transform("tagged", X.print_token), spans).alias("text"))


# ---- extraction


@query("parse_noun_phrase", BASE + ", f AS (SELECT doc_id, sent_id, min(CASE WHEN tag NOT IN ('NN', 'DT', 'AT', 'JJ') THEN pos END) AS first_other, count(token) AS n FROM s LEFT JOIN tt USING (doc_id, sent_id) GROUP BY ALL) SELECT doc_id, CAST(sent_id AS INTEGER) AS sent_id, coalesce(first_other, n) > 0 AS ok, CAST(CASE WHEN coalesce(first_other, n) > 0 THEN coalesce(first_other, n) END AS INTEGER) AS stop FROM f")
def _(spark, d):
    e = tagged_sentences(spark, d).select(*PLACE, E.extract("tagged", E.noun_phrase).alias("e"))
    return e.select(*PLACE, "e.ok", "e.stop")


#: A letter for each tag: N in noun phrases, V verbs, I prepositions. Behind each verb, up to the next: ``w`` is what its phrase can take, which must be
#: noun phrases with or without prepositions; where all is one noun phrase and the next verb has its own phrase, that is a clause within.
LETTER = f"CASE WHEN ({TAG}) IN ('NN', 'DT', 'AT', 'JJ') THEN 'N' WHEN ({TAG}) LIKE 'V%' THEN 'V' WHEN ({TAG}) = 'IN' THEN 'I' ELSE 'X' END"
VERBS = BASE + f""", lt AS (SELECT doc_id, sent_id, array_to_string(list_transform(ts, lambda token: {LETTER}), '') AS z FROM ts),
ps AS (SELECT doc_id, sent_id, z, string_split(z, 'V') AS ps FROM lt),
vb AS (SELECT doc_id, sent_id, unnest(range(2, len(ps) + 1)) AS k, ps, len(ps) AS nv FROM ps),
vw AS (SELECT doc_id, sent_id, k, nv, ps[k] AS piece, regexp_extract(ps[k], '^[NI]*') AS w, CAST(list_sum(list_transform(ps[1 : k - 1], lambda x: len(x) + 1)) AS INTEGER) - 1 AS place FROM vb),
vo AS (SELECT *, w <> '' AND regexp_full_match(w, 'N*(IN+)*') AS good FROM vw),
vc AS (SELECT *, coalesce(good AND piece = w AND regexp_full_match(w, 'N+') AND lead(good) OVER o, false) AS on_ FROM vo WINDOW o AS (PARTITION BY doc_id, sent_id ORDER BY k)),
vh AS (SELECT *, coalesce(lag(on_) OVER o, false) AS inner_ FROM vc WINDOW o AS (PARTITION BY doc_id, sent_id ORDER BY k)),
vg AS (SELECT *, sum(CASE WHEN good AND NOT inner_ THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id, sent_id ORDER BY k) AS g FROM vh),
ve AS (SELECT *, max(CASE WHEN good THEN place + 1 + len(w) END) OVER (PARTITION BY doc_id, sent_id, g ORDER BY k ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS stop FROM vg WHERE good)"""


@query(
    "find_clause",
    VERBS
    + """, fn AS (SELECT doc_id, sent_id, z, instr(z, 'N') - 1 AS start, len(regexp_extract(z, '^[^N]*(N*)', 1)) AS run FROM lt),
fc AS (SELECT f.doc_id, f.sent_id, f.start, e.stop FROM fn f JOIN ve e ON f.doc_id = e.doc_id AND f.sent_id = e.sent_id AND f.start >= 0 AND e.place = f.start + f.run)
SELECT doc_id, CAST(sent_id AS INTEGER) AS sent_id, c.stop IS NOT NULL AS ok, CASE WHEN c.stop IS NOT NULL THEN 'C_CL' END AS label, CAST(c.start AS INTEGER) AS start, CAST(c.stop AS INTEGER) AS stop FROM fn LEFT JOIN fc c USING (doc_id, sent_id)""",
)
def _(spark, d):
    e = tagged_sentences(spark, d).select(*PLACE, E.extract("tagged", E.find_clause).alias("e"))
    return e.select(*PLACE, "e.ok", "e.label", "e.start", "e.stop")


@query("verb_phrases", VERBS + " SELECT doc_id, CAST(sent_id AS INTEGER) AS sent_id, 'C_VP' AS label, CAST(place AS INTEGER) AS start, CAST(stop AS INTEGER) AS stop FROM ve WHERE NOT inner_")
def _(spark, d):
    """The outermost ones."""
    return E.extracted_spans(tagged_sentences(spark, d), E.verb_phrase, *PLACE).filter("parent_id IS NULL").drop("node_id", "parent_id", "depth")


@query("prep_phrases", VERBS + " SELECT doc_id, CAST(sent_id AS INTEGER) AS sent_id, CAST(len(regexp_extract_all(z, 'IN+')) AS INTEGER) AS n FROM lt")
def _(spark, d):
    e = tagged_sentences(spark, d).select(*PLACE, E.extract("tagged", E.prep_phrase, everywhere=True).alias("e"))
    return e.select(*PLACE, F.size(F.filter("e.spans", lambda x: x["label"] == "C_PP")).alias("n"))


@query("one_of_tokens", BASE + " SELECT doc_id, CAST(sent_id AS INTEGER) AS sent_id, CAST(list_min(list_filter(list_transform(range(len(ts) - 1), lambda i: CASE WHEN lower(ts[i + 1]) IN ('the', 'la', 'die') AND ts[i + 2] IN ('of', 'de', 'der', 'and') THEN i END), lambda i: i IS NOT NULL)) AS INTEGER) AS start FROM ts")
def _(spark, d):
    """Where an article without regard to case stands before one of some words."""
    def article() -> E.Parser:
        words = E.choice(*(E.attempt(E.token_is(t, False)) for t in ("the", "la", "die")))
        return E.chunk("X", E.in_order(words, E.one_of(["of", "de", "der", "and"])))

    e = tagged_sentences(spark, d).select(*PLACE, E.extract("tagged", article, everywhere=True).alias("e"))
    return e.select(*PLACE, "e.start")


@query(
    "extract_chunked",
    CHUNKED + """, im AS (SELECT doc_id, sent_id, coalesce(chunk_id, -pos - 1) AS g, min(pos) AS pos, any_value(CASE WHEN chunk_id IS NULL THEN tag ELSE chunk END) AS x, any_value(chunk_id) IS NOT NULL AS c FROM il GROUP BY doc_id, sent_id, coalesce(chunk_id, -pos - 1)),
iw AS (SELECT doc_id, sent_id, string_agg(CASE WHEN c AND x = 'NP' THEN 'n' WHEN c AND x = 'VP' THEN 'v' WHEN c THEN 'c' WHEN x = 'RB' THEN 'r' ELSE 't' END, '' ORDER BY pos) AS z FROM im GROUP BY doc_id, sent_id)
SELECT doc_id, CAST(sent_id AS INTEGER) AS sent_id, CAST(len(regexp_extract_all(z, 'n[vr]')) AS INTEGER) AS n FROM iw""",
)
def _(spark, d):
    """A noun-phrase chunk with a verb-phrase chunk, or an adverb outside of chunks, behind it."""

    def pattern() -> E.Parser:
        return E.chunk("X", E.in_order(E.chunk_is("NP"), E.chunk_is("VP") | E.tag_is("RB")))

    e = chunked(spark, d).select(*PLACE, E.extract("chunked", pattern, everywhere=True).alias("e"))
    return e.select(*PLACE, F.size(F.filter("e.spans", lambda x: x["label"] == "X")).alias("n"))


@query(
    "mail_messages",
    """WITH a AS (SELECT conv_id AS file, string_agg('From ' || role || ' at ' || turn || chr(10) || 'Subject: x' || chr(10) || chr(10) || text || chr(10) || chr(10), '' ORDER BY turn) AS t FROM conversations GROUP BY conv_id),
p AS (SELECT file, string_split(chr(10) || t, chr(10) || 'From ')[2:] AS ps FROM a),
m AS (SELECT file, unnest(range(len(ps))) AS msg_id, unnest(ps) AS m FROM p)
SELECT file, CAST(msg_id AS INTEGER) AS msg_id, CASE WHEN instr(m, chr(10) || chr(10)) > 0 THEN trim(trim(substring(m, instr(m, chr(10) || chr(10)) + 2), chr(10))) ELSE '' END AS body FROM m""",
)
def _(spark, d):
    """Conversations written as mail archives and read back."""
    c = read(spark, d, "conversations")
    mail = F.concat(F.lit("From "), "role", F.lit(" at "), F.col("turn").cast("string"), F.lit("\nSubject: x\n\n"), "text", F.lit("\n\n"))
    archives = c.groupBy(F.col("conv_id").alias("file")).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("turn", mail.alias("m")))), lambda x: x["m"]), "").alias("text"))
    return S.mail_messages(archives).select("file", "msg_id", F.trim(F.btrim("body", F.lit("\n"))).alias("body"))
