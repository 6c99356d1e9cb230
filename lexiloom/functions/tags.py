"""Tag sets and their codecs.

A tag is kept as its surface string. Parsing never fails: what is no tag of
the set becomes ``Unk``. Chunk and entity labels are parsed strictly, with a
null for what is none.
"""

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UNKNOWN = "Unk"

#: Brown tags by what follows the first part.
_BROWN = {
    "": "WRB WQL WPS WPO WDT VBZ VBN VBG VBD VB UH TO RP RN RBT RBR RB QLP QL PPSS PPS PPO PPLS PPL PN OD NRS NR NPS NP NNS NN MD JJT JJS JJR JJ IN HVZ HVN HVG HVD HV EX DTX DTS DTI DT DOZ DOD DO CS CD CC BEZ BER BEN BEM BEG BEDZ BED BE AT AP ABX ABN ABL",
    "$": "WP RB PP PP$ PN NR NPS NP NNS NN JJ DT CD AP",
    "*": "MD HVZ HVD HV DOZ DOD DO BEZ BER BEM BEDZ BED",
    "+BEZ": "WRB WPS WDT RB PPSS PPS PN NP NN EX DTS DT FW-DT",
    "+HVD": "WPS PPSS PPS PN NN EX",
    "+HVZ": "WPS WDT PPS PN NP NN EX",
    "+MD": "WRB WPS PPSS PPS PN NR NP NNS NN EX DT",
    "+IN": "WRB VB RP NN IN FW-PPO",
    "+BER": "WRB WDT PPSS",
    "+TO": "VBN VBG VB MD HV",
    "+DO": "WRB",
    "+DOD": "WRB WDT",
    "+HV": "PPSS MD FW-PPSS",
    "+VB": "VB TO PPSS FW-TO",
    "+CS": "RBR RB JJR",
    "+PPSS": "MD DO",
    "+PPO": "VB IN",
    "+NN": "NN FW-IN FW-AT",
    "+NP": "FW-IN FW-AT",
    "+JJ": "VB JJ",
    "+AT": "VB FW-IN",
}
_BROWN_OTHER = "VB+RP AP+AP FW-RB+CC FW-PPL+VBZ PPSS+BEM PPSS+BEZ* WDT+BER+PP WDT+DO+PPS WRB+DOD* WRB+DOZ"
_BROWN_FOREIGN = "WPS WPO WDT VBZ VBN VBG VBD VB UH RB QL PPSS PPS PPO PPL PP$ PN OD NR NPS NP NNS NN$ NN JJT JJR JJ IN HV DTS DT CS CD CC BEZ BER BE AT *"
_CONLL = "WRB WP$ WP WDT VBZ VBP VBN VBG VBD VB UH TO SYM RP RBS RBR RB PRP$ PRP POS PDT NNPS NNP NNS NN MD LS JJS JJR JJ IN FW EX DT CD CC"


@dataclass(frozen=True)
class TagSet:
    name: str
    tags: frozenset | None  # None: any text is a tag
    marks: frozenset = frozenset()  # tags that are signs, parsed as they stand
    determiners: frozenset = frozenset({"DT"})
    start: str = "START"
    end: str = "END"
    chunks: frozenset | None = None
    out: str = "O"
    term: str = "."


BROWN = TagSet(
    "brown",
    frozenset([f"{x}{end}" for end, some in _BROWN.items() for x in some.split()] + _BROWN_OTHER.split() + [f"FW-{x}" for x in _BROWN_FOREIGN.split()] + ["START", "END"]),
    frozenset("()*,-.:"),
    frozenset("DT DT$ DT+BEZ DT+MD DTI DTS DTS+BEZ DTX".split()),
    chunks=frozenset("C_NP C_VP C_PP C_CL C_O".split()),
    out="C_O",
)
CONLL = TagSet(
    "conll",
    frozenset([*_CONLL.split(), "START", "END"]),
    frozenset(["#", "$", "(", ")", "''", "``", ",", ".", ":"]),
    chunks=frozenset("ADJP ADVP CONJP INTJ LST NP PP PRT SBAR UCP VP O".split()),
)
WIKINER = TagSet("wikiner", None, chunks=frozenset("LOC MISC ORG PER C_O".split()), out="C_O", start="-START-", end="-END-")
RAW = TagSet("raw", None, start="-START-", end="-END-")
TAGSETS = {t.name: t for t in (BROWN, CONLL, WIKINER, RAW)}
#: Named-entity classes of the shared task.
ENTITIES = ("PER", "ORG", "LOC", "MISC")


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def parse_tag(text, tagset: TagSet = RAW) -> Column:
    """The canonical tag of a text: signs as they stand, else upper case with ``_`` for ``-`` allowed, else ``Unk``.

    As a constructor may be written so, surrounding spaces and balanced parentheses are taken off.
    """
    text = _c(text)
    if tagset.tags is None:
        return text
    inner = F.regexp_replace(text, r"^[\s(]+|[\s)]+$", "")
    balanced = F.length(F.regexp_replace(text, r"[^(]", "")) == F.length(F.regexp_replace(text, r"[^)]", ""))
    upper = F.upper(inner)
    name = F.translate(upper, "_", "-") if tagset.name == "brown" else upper
    return F.when(text.isin(*sorted(tagset.marks)), text).when(balanced & name.isin(*sorted(tagset.tags)), name).when(text.isNotNull(), F.lit(UNKNOWN))


def parse_tag_text(text: str, tagset: TagSet = RAW) -> str:
    """``parse_tag`` of one string, outside Spark."""
    if tagset.tags is None or text in tagset.marks:
        return text
    inner = text.lstrip(" \t\n(").rstrip(" \t\n)").upper()
    name = inner.replace("_", "-") if tagset.name == "brown" else inner
    return name if name in tagset.tags and text.count("(") == text.count(")") else UNKNOWN


def is_determiner(tag, tagset: TagSet = RAW) -> Column:
    return _c(tag).isin(*sorted(tagset.determiners))


def parse_chunk(text, tagset: TagSet = RAW, compat: bool = False) -> Column:
    """The chunk label, or null if it is none of the set's.

    Brown labels are read with or without their ``C_``; with ``compat`` only without.
    """
    text = _c(text)
    if tagset.chunks is None:
        return text
    if tagset.name == "brown":
        known = F.concat(F.lit("C_"), text)
        return F.when(known.isin(*sorted(tagset.chunks)), known).when(F.lit(not compat) & text.isin(*sorted(tagset.chunks)), text)
    return F.when(text.isin(*sorted(tagset.chunks)), text)


def parse_entity(text) -> Column:
    return F.when(_c(text).isin(*ENTITIES), _c(text))


def dimension(spark: SparkSession, tagset: TagSet) -> DataFrame:
    """``(tagset, surface, is_dt)`` rows of a closed tag set."""
    rows = [(tagset.name, t, t in tagset.determiners) for t in sorted((tagset.tags or frozenset()) | tagset.marks | {UNKNOWN})]
    return spark.createDataFrame(rows, "tagset string, surface string, is_dt boolean")
