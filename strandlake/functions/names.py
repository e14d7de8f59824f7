"""Names of chromosomes, annotation classes, samples and files, as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Annotation classes in the order that breaks ties.
CENSAT_CLASSES = ("asat_hor_active", "asat_hor", "asat_mon", "hsat1a", "hsat1b", "hsat2", "hsat3", "bsat", "gsat", "censat_other", "rdna", "ct", "subterminal", "mon")
REPEAT_CLASSES = ("line", "sine", "ltr", "dna", "satellite", "simple_repeat", "low_complexity", "rrna", "trna", "snrna", "retroposon", "rc", "repeat_unknown")
EXTRA_CLASSES = ("segdup", "telomere", "gene")
FEATURES = (*CENSAT_CLASSES, *REPEAT_CLASSES, *EXTRA_CLASSES)
TRACK_FEATURES = {"censat": CENSAT_CLASSES, "repeatmasker": REPEAT_CLASSES, "segdup": ("segdup",), "telomere": ("telomere",), "gene": ("gene",)}
#: Classes of satellite names.
CENSAT_SPELLINGS = {
    "active_hor": "asat_hor_active",
    "activehor": "asat_hor_active",
    "active-hor": "asat_hor_active",
    "hor_active": "asat_hor_active",
    "livehor": "asat_hor_active",
    "hor": "asat_hor",
    "dhor": "asat_hor",
    "divergent_hor": "asat_hor",
    "mon": "asat_mon",
    "monomer": "asat_mon",
    "monomeric": "asat_mon",
    "mixedalpha": "asat_mon",
    "mixed_alpha": "asat_mon",
    "hsat1a": "hsat1a",
    "hsat1b": "hsat1b",
    "hsat2": "hsat2",
    "hsat3": "hsat3",
    "hsat2_3": "hsat3",
    "hsat23": "hsat3",
    "hsat2and3": "hsat3",
    "hsat2_and_3": "hsat3",
    "hsat4": "censat_other",
    "hsat5": "censat_other",
    "bsat": "bsat",
    "betasat": "bsat",
    "beta": "bsat",
    "gsat": "gsat",
    "gsatii": "gsat",
    "gsatx": "gsat",
    "gammasat": "gsat",
    "tar": "gsat",
    "tar1": "gsat",
    "censat": "censat_other",
    "cen": "censat_other",
    "novel": "censat_other",
    "noveltandem": "censat_other",
    "rdna": "rdna",
    "ct": "ct",
    "transition": "ct",
    "sst1": "subterminal",
    "sst": "subterminal",
    "subterminal": "subterminal",
    "subtelo": "subterminal",
    "subtelomeric": "subterminal",
}
#: Details that refine the class censat_other, in order; and names that mean nothing.
CENSAT_DETAILS = (("sst1", "subterminal"), ("subtelo", "subterminal"), ("subterminal", "subterminal"), ("tar1", "gsat"), ("tar", "gsat"), ("gsat", "gsat"))
IGNORED = ("gap", "n", "unknown", "na", ".")
#: Classes of repeat names.
REPEAT_SPELLINGS = {
    "line": "line",
    "sine": "sine",
    "ltr": "ltr",
    "dna": "dna",
    "satellite": "satellite",
    "sat": "satellite",
    "beta": "satellite",
    "simple_repeat": "simple_repeat",
    "simple": "simple_repeat",
    "low_complexity": "low_complexity",
    "rrna": "rrna",
    "trna": "trna",
    "snrna": "snrna",
    "retroposon": "retroposon",
    "rc": "rc",
    "unknown": "repeat_unknown",
    "unspecified": "repeat_unknown",
    "undefined": "repeat_unknown",
}
#: Superpopulations of populations; names of the mitochondrion; texts that mean missing; satellite prefixes.
SUPERPOPULATIONS = {
    "ACB": "AFR", "ASW": "AFR", "ESN": "AFR", "GWD": "AFR", "LWK": "AFR", "MSL": "AFR", "YRI": "AFR", "ASL": "AFR", "MKK": "AFR",
    "CLM": "AMR", "MXL": "AMR", "PEL": "AMR", "PUR": "AMR",
    "CDX": "EAS", "CHB": "EAS", "CHS": "EAS", "JPT": "EAS", "KHV": "EAS",
    "CEU": "EUR", "FIN": "EUR", "GBR": "EUR", "IBS": "EUR", "TSI": "EUR",
    "BEB": "SAS", "GIH": "SAS", "ITU": "SAS", "PJL": "SAS", "STU": "SAS",
}
MITOCHONDRIA = ("m", "mt", "mito", "mtdna", "chrmt")
NULLISH = ("", "na", "n/a", "nan", "none", "null", "-", ".")
SATELLITE_PREFIXES = ("asat", "hsat", "bsat", "gsat", "rdna")


def lookup(key: Column, table: dict[str, str]) -> Column:
    """``table[key]`` or null."""
    return F.element_at(F.create_map(*[F.lit(x) for pair in table.items() for x in pair]), key)


def text_or_empty(c: Column) -> Column:
    """Trimmed text, with missing values and their spellings as ''."""
    t = F.trim(F.coalesce(c.cast("string"), F.lit("")))
    return F.when(F.lower(t).isin(*NULLISH), "").otherwise(t)


def stripped(c: Column) -> Column:
    """Text without white space around it; null as ''."""
    return F.regexp_replace(F.coalesce(c.cast("string"), F.lit("")), r"^\s+|\s+$", "")


def normalize_chrom(c: Column) -> Column:
    """chr1..chr22, chrX, chrY, chrM from 'chr', bare and PanSN ('sample#1#chr21') names; '' otherwise."""
    last = stripped(F.element_at(F.split(stripped(c), "#"), -1))
    core = F.lower(F.regexp_replace(last, "(?i)^chr", ""))
    number = F.when(core.rlike("^[0-9]+$"), core.try_cast("int"))
    return F.when(core.isin(*MITOCHONDRIA), "chrM").when(core.isin("x", "y"), F.concat(F.lit("chr"), F.upper(core))).when(number.between(1, 22), F.concat(F.lit("chr"), number.cast("string"))).otherwise("")


_UNLOCALISED = r"(?i)^(chr(?:[0-9]{1,2}|[XYM]|MT))_\S*_(?:random|alt|fix)$"


def ucsc_chrom(c: Column) -> Column:
    """The chromosome of a UCSC name, also of its unlocalised pieces (_random, _alt, _fix); '' for unplaced ones and all else."""
    name = stripped(c)
    piece = F.regexp_extract(name, _UNLOCALISED, 1)
    return F.when(name.rlike("(?i)^chrUn[_.]"), "").when(piece != "", normalize_chrom(piece)).otherwise(normalize_chrom(name))


def ucsc_placed(c: Column) -> Column:
    """True only for a whole chromosome."""
    name = stripped(c)
    return (normalize_chrom(name) != "") & ~name.rlike("(?i)^chrUn[_.]") & ~name.rlike(_UNLOCALISED)


def s3_to_https(c: Column) -> Column:
    """s3://bucket/key as https; https stays; all else is ''."""
    t = text_or_empty(c)
    return F.when(t.rlike("^s3://[^/]+/.+"), F.regexp_replace(t, "^s3://([^/]+)/(.+)$", "https://$1.s3.amazonaws.com/$2")).when(t.rlike("^https?://"), t).otherwise("")


def superpopulation(c: Column) -> Column:
    return F.coalesce(lookup(F.upper(F.coalesce(c, F.lit(""))), SUPERPOPULATIONS), F.lit(""))


def _without_index(key: Column) -> Column:
    """A key without trailing ``_<chromosome or number>`` parts."""
    return F.regexp_replace(key, "(_([0-9]+|[xym]))+$", "")


def _first_known(keys: Column, whole_first: bool) -> Column:
    """(key, kind) of the first key with a class: as it is (if ``whole_first``) or without its index."""

    def known(key: Column) -> Column:
        short = F.struct(_without_index(key).alias("key"), lookup(_without_index(key), CENSAT_SPELLINGS).alias("kind"))
        if not whole_first:
            return short
        whole = F.struct(key.alias("key"), lookup(key, CENSAT_SPELLINGS).alias("kind"))
        return F.when(whole["kind"].isNotNull(), whole).otherwise(short)

    return F.get(F.filter(F.transform(keys, known), lambda x: x["kind"].isNotNull()), F.lit(0))


def censat_class(c: Column) -> Column:
    """Satellite class of a track name such as ``hor_1_1(S3C1H2-A,B)`` or ``GAP,HSat2``; '' if it has none.

    The first label before the brackets that has a class counts, else the first one in
    them; a single detail that ends in L makes a ``hor`` an active one, details refine
    the class censat_other.
    """
    name = stripped(c)
    wrapped = name.rlike(r"(?s)^[^(]*\(.*\)$")
    head = F.lower(F.when(wrapped, F.regexp_extract(name, r"(?s)^([^(]*)\(", 1)).otherwise(name))
    detail = F.lower(stripped(F.when(wrapped, F.regexp_extract(name, r"(?s)^[^(]*\((.*)\)$", 1)).otherwise("")))
    parts = lambda text: F.transform(F.split(text, ","), stripped)
    found = F.coalesce(_first_known(F.filter(parts(head), lambda t: ~t.isin(*IGNORED)), True), _first_known(parts(detail), False))
    kind = F.coalesce(found["kind"], F.lit(""))
    live = (found["key"] == "hor") & ~detail.contains(",") & detail.endswith("l")
    refined = kind
    for needle, meant in reversed(CENSAT_DETAILS):
        refined = F.when(F.exists(parts(detail), lambda d: d.startswith(needle)), meant).otherwise(refined)  # noqa: B023
    return F.when(live, "asat_hor_active").when((kind == "censat_other") & (detail != ""), refined).otherwise(kind)


def repeat_class(kind: Column, family: Column) -> Column:
    """Repeat class from class and family; the family decides only where the class is not known, and only if it is specific."""

    def own(c: Column) -> Column:
        first = F.split(stripped(c), "/")[0]
        key = F.translate(F.lower(stripped(F.regexp_replace(first, r"\?+$", ""))), "- ", "__")
        return lookup(key, REPEAT_SPELLINGS)

    second = own(family)
    return F.coalesce(own(kind), F.when(second != "repeat_unknown", second), F.lit(""))


def safe_name(c: Column) -> Column:
    """Letters, digits, dot, dash and underscore; the rest becomes one underscore."""
    return F.regexp_replace(c, r"[^A-Za-z0-9._-]+", "_")


def is_satellite(c: Column) -> Column:
    return c.rlike("^(" + "|".join(SATELLITE_PREFIXES) + ")")


def chrom_order(c: Column) -> Column:
    """Natural order of chromosome names."""
    core = F.regexp_replace(c, "^chr", "")
    return F.when(core == "X", 23).when(core == "Y", 24).when(core == "M", 25).otherwise(F.coalesce(core.try_cast("int"), F.lit(99)))
