"""Command line: tagging, training and evaluation.

    python -m lexiloom tag MODEL SENTENCE
    python -m lexiloom train-pos [--tagset T] CORPUS... OUT
    python -m lexiloom train-chunk CORPUS... OUT
    python -m lexiloom train-ner CORPUS... OUT
    python -m lexiloom eval [--tagset T] MODEL CORPUS...
"""

import argparse
import sys

from pyspark.sql import SparkSession

from .functions import tags as T
from .operators import chunking as K
from .operators import taggers as G
from .sources import corpora as S
from .sources import models as M


def tagged_sentences(spark: SparkSession, paths: list[str], tagset: T.TagSet, form: str = "tagged"):
    """Rows ``(doc_id, sent_id, tagged)`` of corpora, each file read by itself."""
    texts = S.read_text(spark, paths)
    if form == "tagged":
        rows = S.read_tagged(texts, tagset)
    else:
        rows = S.tagged_sentences(S.read_iob(texts, tagset))
    return S.array_form(rows, "doc_id", "sent_id")


def chunk_rows(rows):
    """IOB rows with whole-chunk labels, without malformed ones."""
    return K.iob_chunks(rows.filter("_error IS NULL"), "doc_id", "sent_id")


def run(spark: SparkSession, args: list[str]) -> str:
    p = argparse.ArgumentParser("lexiloom", description=__doc__, formatter_class=argparse.RawDescriptionHelpFormatter)
    sub = p.add_subparsers(dest="command", required=True)
    tag = sub.add_parser("tag")
    tag.add_argument("model")
    tag.add_argument("sentence")
    for name in ("train-pos", "train-chunk", "train-ner"):
        c = sub.add_parser(name)
        c.add_argument("corpora", nargs="+")
        c.add_argument("out")
        c.add_argument("--tagset", choices=T.TAGSETS, default={"train-pos": "raw", "train-chunk": "conll", "train-ner": "wikiner"}[name])
        c.add_argument("--format", choices=("tagged", "iob"), default="tagged")
        c.add_argument("--iterations", type=int, default=G.ITERATIONS)
        c.add_argument("--seed", type=int, default=0)
    e = sub.add_parser("eval")
    e.add_argument("model")
    e.add_argument("corpora", nargs="+")
    e.add_argument("--tagset", choices=T.TAGSETS, default="raw")
    e.add_argument("--format", choices=("tagged", "iob"), default="tagged")
    a = p.parse_args(args)
    if a.command == "tag":
        df = spark.createDataFrame([(0, a.sentence)], "doc_id int, text string")
        return M.load(spark, a.model).tag_text(df).first()["text"]
    tagset = T.TAGSETS[a.tagset]
    if a.command == "eval":
        got = M.load(spark, a.model).evaluate(tagged_sentences(spark, a.corpora, tagset, a.format)).first()
        return f"accuracy {got['accuracy']}, {got['n_tokens']} tokens"
    if a.command == "train-pos":
        model = G.new_tagger(spark, a.iterations, a.seed).fit(tagged_sentences(spark, a.corpora, tagset, a.format))
    else:
        read = S.read_iob if a.command == "train-chunk" else S.read_wikiner
        model = K.new_chunker(spark, tagset, a.iterations, a.seed).fit(chunk_rows(read(S.read_text(spark, a.corpora), tagset)), "doc_id", "sent_id")
    model.save(spark, a.out)
    return f"saved {a.out}"


def main() -> None:
    print(run(SparkSession.builder.appName("lexiloom").getOrCreate(), sys.argv[1:]))

