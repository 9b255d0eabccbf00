"""Secret scan with DataFrame functions only.

Three kinds are found by pattern. A fourth kind, ``markov``, adds runs of token characters that a
first-order Markov model of random strings explains better than one of ordinary identifiers. Both
models are counted on labelled samples of the corpus; their log-likelihood ratio is a table of
character pairs that is part of the plan.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from farsight.llm.common import bounded_sample, sha256_hex
from farsight.llm.registry import query, table
from farsight.llm.spans import ends, free_of, matched, pieces, running

# Kinds in their order, and the patterns of the base kinds (fixed values).
KINDS = ("assign", "access", "hex", "markov")
ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]+"
MIN_VALUE, MIN_ACCESS, MIN_HEX = 6, 20, 24

# Characters of a candidate token and its least length.
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"
MIN_TOKEN = 20
# A token is a secret if random strings explain it better by more than this many nats.
MIN_RATIO = 12.0
# Labelled rows that the models are counted on, and words of each that stand for the ordinary class.
SAMPLE_ROWS, SAMPLE_WORDS = 2000, 100


def _kinds() -> list[tuple[str, str]]:
    """Name and pattern of each kind. Runs are maximal, so the least lengths can stand in the pattern."""
    patterns = (ASSIGN, ACCESS[:-1] + f"{{{MIN_ACCESS - 4},}}", HEX[:-1] + f"{{{MIN_HEX},}}", f"[{ALPHABET[:-1]}-]{{{MIN_TOKEN},}}")
    return list(zip(KINDS, patterns, strict=True))


def _kept_spans(kind: int, matches: Column, parts: Column, keep: Column) -> Column:
    """Spans (start, kind, end), in code points, of the matches for which ``keep`` (an array of booleans) holds."""
    zipped = F.arrays_zip(matches.alias("match"), ends(parts, matches).alias("end"), keep.alias("keep"))
    span = lambda z: F.struct((z["end"] - F.length(z["match"])).alias("start"), F.lit(kind).alias("kind"), z["end"].alias("end"))
    none = F.array().cast("array<struct<start:int,kind:int,end:int>>")
    return F.when(F.size(matches) > 0, F.transform(F.filter(zipped, lambda z: z["keep"]), span)).otherwise(none)


# --- the models -------------------------------------------------------------------


def labelled_samples(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", sample_rows: int = SAMPLE_ROWS, sample_words: int = SAMPLE_WORDS
) -> DataFrame:
    """(random boolean, token string) from a sample of ``sample_rows`` rows, chosen by a hash of id and text, and ``sample_words`` words of each.

    Random: digests of the texts in hex and base 64, and the values that the base patterns find.
    Ordinary: words of the texts, alone, in capitals and joined as identifiers and paths are, and
    runs of one punctuation character.
    """
    text = F.coalesce(F.col(text_column), F.lit(""))
    sample = bounded_sample(docs.select(F.col(id_column).alias("id"), text.alias("t")), ["id", "t"], sample_rows).select("t")
    digest = F.unhex(F.sha2("t", 512))
    found = F.filter(F.regexp_extract_all("t", F.lit(ASSIGN), F.lit(2)), lambda v: F.length(v) >= MIN_VALUE)
    secret = F.concat(F.array(F.base64(digest), F.translate(F.base64(digest), "+/", "-_"), F.sha2("t", 256)), found)
    words = F.slice(F.regexp_extract_all("t", F.lit("[A-Za-z]{2,}"), F.lit(0)), 1, sample_words)

    def joined(sep: str, change=lambda w: w) -> Column:
        return F.array_join(F.transform(words, change), sep)

    plain = F.array(joined("_", F.lower), joined("-", F.lower), joined("/", F.lower), joined("_", F.upper), joined("", F.initcap), joined("="), joined("+"))
    runs = F.array(*[F.lit(c * 24) for c in "-_=+/0"])
    both = F.concat(
        F.transform(secret, lambda x: F.struct(F.lit(True).alias("random"), x.alias("token"))),
        F.transform(F.concat(plain, runs), lambda x: F.struct(F.lit(False).alias("random"), x.alias("token"))),
    )
    return sample.select(F.explode(both).alias("s")).select("s.random", "s.token").where(F.length("token") > 1)


def pair_counts(samples: DataFrame) -> DataFrame:
    """(random, first, second, n): how often a character follows another in either class."""
    chars = F.split("token", "(?!^)")
    n = F.size(chars) - 1
    pairs = F.arrays_zip(F.slice(chars, 1, n).alias("first"), F.slice(chars, 2, n).alias("second"))
    flat = samples.select("random", F.explode(pairs).alias("p"))
    return flat.groupBy("random", F.col("p.first").alias("first"), F.col("p.second").alias("second")).agg(F.count("*").alias("n"))


def ratio_table(counts: list[tuple[bool, str, str, int]], smoothing: float = 0.5) -> list[float]:
    """log P(second | first, random) - log P(second | first, ordinary), by pair of alphabet places."""
    size = len(ALPHABET)
    place = {c: i for i, c in enumerate(ALPHABET)}
    n = {True: [smoothing] * size**2, False: [smoothing] * size**2}
    for random, first, second, k in counts:
        if first in place and second in place:
            n[random][place[first] * size + place[second]] += k
    rows = {label: [sum(v[i * size : (i + 1) * size]) for i in range(size)] for label, v in n.items()}
    return [math.log(n[True][k] / rows[True][k // size]) - math.log(n[False][k] / rows[False][k // size]) for k in range(size**2)]


def train(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", sample_rows: int = SAMPLE_ROWS) -> list[float]:
    """The ratio table of a corpus: at most two counts per pair of alphabet characters are collected."""
    counts = pair_counts(labelled_samples(docs, id_column, text_column, sample_rows))
    return ratio_table([tuple(r) for r in counts.where(F.col("first").isin(*ALPHABET) & F.col("second").isin(*ALPHABET)).collect()])


def log_ratio(token: Column, ratios: list[float]) -> Column:
    """Sum of the table over the character pairs of ``token``."""
    size = len(ALPHABET)
    # Written as one string each, which the optimizer folds to an array constant.
    places = F.split(F.lit(",".join(str(ALPHABET.find(chr(c))) for c in range(128))), ",").cast("array<int>")
    pairs = F.split(F.lit(",".join(map(str, ratios))), ",").cast("array<double>")
    codes = F.transform(F.split(token, "(?!^)"), lambda c: F.get(places, F.ascii(c)))
    zero = F.struct(F.lit(-1).alias("last"), F.lit(0.0).alias("sum"))
    step = lambda acc, c: F.struct(
        c.alias("last"), (acc["sum"] + F.when(acc["last"] < 0, 0.0).otherwise(F.get(pairs, acc["last"] * size + c))).alias("sum"))
    return F.aggregate(codes, zero, step, lambda acc: acc["sum"])


def scan_secrets(
    docs: DataFrame, ratios: list[float], text_column: str = "text", min_ratio: float = MIN_RATIO, names: tuple[str, str] = ("base_spans", "spans"),
) -> DataFrame:
    """All columns of ``docs`` with ``base_spans`` and ``spans`` (``names``), replacing columns of those names.

    Both are arrays of (start, kind, end), sorted, in code points with the end exclusive; kind is
    the place in ``KINDS``, counted from 1. ``spans`` holds the base spans and the tokens that the
    models add; a token that overlaps a base span adds nothing. Null and empty texts have none. The
    work on a text grows with its length and n log n of its n matches.
    """
    base, every = names
    kept = [c for c in docs.columns if c not in names]
    text = F.col("text")
    # The row is packed, so that none of its columns clashes with a name used here.
    packed = docs.select(F.struct(*kept).alias("row"), F.coalesce(F.col(text_column), F.lit("")).alias("text"))
    found = packed.select("*", *[matched(text, pattern).alias(f"m_{k}") for k, pattern in _kinds()])
    cut = found.select(
        "row", *[f"m_{k}" for k in KINDS], *[pieces(text, pattern, F.col(f"m_{k}")).alias(f"p_{k}") for k, pattern in _kinds()],
        F.when(F.size("m_assign") > 0, F.regexp_extract_all(text, F.lit(ASSIGN), F.lit(2))).alias("values"))
    all_of = lambda k: F.transform(f"m_{k}", lambda _: F.lit(True))
    keep = {
        "assign": F.transform("values", lambda v: F.length(v) >= MIN_VALUE), "access": all_of("access"), "hex": all_of("hex"),
        "markov": F.transform("m_markov", lambda t: log_ratio(t, ratios) > min_ratio),
    }
    spans = cut.select("row", *[_kept_spans(i, F.col(f"m_{k}"), F.col(f"p_{k}"), keep[k]).alias(k) for i, k in enumerate(KINDS, 1)])
    both = spans.select("row", F.array_sort(F.concat(*KINDS[:3])).alias("base"), F.array_sort(F.concat(*KINDS)).alias("every"))
    apart = F.when(F.exists("every", lambda s: s["kind"] == 4), free_of(F.col("every"), lambda s: s["kind"] < 4)).otherwise(F.col("every"))
    return both.select(*[F.col("row")[c].alias(c) for c in kept], F.col("base").alias(base), apart.alias(every))


def span_text(spans: Column | str) -> Column:
    """``kind:start:end`` of each span, comma-joined."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(names, s["kind"]), s["start"], s["end"])), ",")


def mask_secrets(docs: DataFrame, ratios: list[float], text_column: str = "text", mark: str = "[SECRET]", min_ratio: float = MIN_RATIO) -> DataFrame:
    """``docs`` with every found span of the text replaced by ``mark``; overlapping spans give one mark. A null text stays
    null and an empty one empty."""
    # Names that no column of ``docs`` has.
    base, every, chars = (f"_{k}_{len(docs.columns)}_{'_'.join(docs.columns)}"[:200] for k in ("base", "spans", "chars"))
    text = F.col(text_column)
    found = scan_secrets(docs, ratios, text_column, min_ratio, (base, every)).drop(base)
    # Cut into characters once, and only where something is masked; the pieces between spans are joined again.
    cut = found.withColumn(chars, F.when(F.size(every) > 0, F.split(text, "")))
    reached = running(F.transform(every, lambda s: s["end"]), F.greatest)
    zipped = F.arrays_zip(F.col(every).alias("span"), F.concat(F.array(F.lit(0)), reached).alias("before"))

    def piece(z: Column) -> Column:
        between = F.array_join(F.slice(chars, z["before"] + 1, z["span"]["start"] - z["before"]), "")
        return F.when(z["span"].isNull(), F.array_join(F.slice(chars, z["before"] + 1, F.size(chars)), "")).when(
            z["span"]["start"] >= z["before"], F.concat(between, F.lit(mark))).otherwise("")

    masked = F.array_join(F.transform(zipped, piece), "")
    return cut.withColumn(text_column, F.when(F.size(every) > 0, masked).otherwise(text)).select(*docs.columns)


@query("op10_secrets")
def secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets of every document; the models are counted on a sample of the same table."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = scan_secrets(docs, train(docs)).drop("text")
    count = lambda kind: F.size(F.filter("base_spans", lambda s: s["kind"] == kind)).cast("long")
    return found.select(
        "doc_id", count(1).alias("n_assign"), count(2).alias("n_access"), count(3).alias("n_hex"),
        sha256_hex(span_text("base_spans").cast("binary")).alias("base_sha256"), span_text("spans").alias("spans"),
    )
