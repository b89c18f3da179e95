"""Secret scans in DataFrame operations only.

Three base patterns find their matches by regular expressions; beside them,
every candidate string is searched by a sliding window: the Shannon entropy of
the window's characters is kept up to date from counts that change by one
character in and one out, per character class (hexadecimal digits; the base-64
alphabet), and a string whose best window reaches its class's bound is a span,
unless the allow-list knows it or a base span already covers it.

Spark gives the matches of a pattern but not where they lie; splitting the text
by the same pattern gives what lies between, and running sums of both lengths
give the places (code points, end exclusive).  Nothing is shuffled.

Defined results: a null text is empty; an empty text has no spans; rows that
repeat give a row each; very long texts take time in proportion (running sums
go by blocks); other columns are ignored.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The base kinds in the order of the report.
ASSIGN = r"""((?:[Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy]))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{16,}"  # 20 or more characters: the run after the first AKIA decides, so shorter ones can be left out here
HEX = r"[0-9a-f]{24,}"  # maximal runs, so shorter ones can be left out here
LEAST_ASSIGNED = 6
KINDS = ("assign", "access", "hex", "entropy_hex", "entropy_base64")

WINDOW = 20
CANDIDATE = r"(?<![A-Za-z0-9+/=_-])[A-Za-z0-9+/=_-]{20,}"
HEX_DIGITS = "0123456789abcdef"
BASE64 = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/=_-"
#: Bits per character that the best window must reach.
LEAST_BITS = {"entropy_hex": 3.0, "entropy_base64": 3.8}
#: Strings that are known not to be secrets: examples and fillers, alphabets, UUIDs, sub-resource digests, plain words.
ALLOWED = (
    r"(?i)example|placeholder|changeme|dummy|lorem|x{6}|0{8}|0123456789|abcdefghij"
    r"|^[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}$|^sha(?:1|256|384|512)-|^[a-z_=/+-]+$|^[0-9+/=_-]+$"
)
BLOCK = 256


def running_sums(lengths: Column) -> Column:
    """Running sums of an array; blocks keep the copying linear."""
    empty = F.array().cast("array<bigint>")

    def add(sums: Column, x: Column) -> Column:
        return F.array_append(sums, F.coalesce(F.try_element_at(sums, F.lit(-1)), F.lit(0)) + x.cast("bigint"))

    n_blocks = F.ceil(F.size(lengths) / F.lit(BLOCK)).cast("int")
    blocks = F.transform(F.sequence(F.lit(1), n_blocks), lambda b: F.aggregate(F.slice(lengths, (b - 1) * BLOCK + 1, F.lit(BLOCK)), empty, add))

    def shift(acc: Column, block: Column) -> Column:
        base = F.coalesce(acc["last"], F.lit(0).cast("bigint"))
        return F.struct(F.array_append(acc["all"], F.transform(block, lambda v: v + base)).alias("all"), (base + F.element_at(block, -1)).alias("last"))

    start = F.struct(F.array().cast("array<array<bigint>>").alias("all"), F.lit(0).cast("bigint").alias("last"))
    return F.flatten(F.aggregate(blocks, start, shift, lambda acc: acc["all"]))


def _when_found(text: Column, pattern: str, value: Column) -> Column:
    """``value`` where the pattern occurs: most texts need no arrays."""
    return F.when(text.rlike(pattern), value)


def _places(found: Column, between: Column) -> Column:
    """Array of struct(start, end, match) from matches and the pieces between them."""
    ends = running_sums(F.zip_with(found, F.slice(between, F.lit(1), F.size(found)), lambda m, p: F.char_length(m) + F.char_length(p)))
    return F.zip_with(found, ends, lambda m, e: F.struct((e - F.char_length(m)).alias("start"), e.alias("end"), m.alias("match")))


def best_window(string: Column, alphabet: str, window: int = WINDOW) -> Column:
    """Largest entropy, in bits a character, of any window of ``string`` over the characters of ``alphabet``.

    The state holds a count per character of the alphabet and the sum of
    c * log2(c); one step adds a character and takes one away.  0 for strings
    shorter than the window.
    """
    logs = F.array(*[F.lit(0.0 if c < 1 else c * math.log2(c)) for c in range(window + 2)])
    start = F.struct(F.array_repeat(F.lit(0), len(alphabet)).alias("counts"), F.lit(0.0).alias("sum"), F.lit(0.0).alias("best"))

    def over(codes: Column) -> Column:
        def step(state: Column, i: Column) -> Column:
            new, old = F.get(codes, i), F.coalesce(F.get(codes, i - window), F.lit(-1))
            had, lost = F.get(state["counts"], new), F.get(state["counts"], old)
            total = F.when(new == old, state["sum"]).otherwise(
                state["sum"] + F.get(logs, had + 1) - F.get(logs, had) + F.coalesce(F.get(logs, lost - 1) - F.get(logs, lost), F.lit(0.0))
            )
            counts = F.transform(state["counts"], lambda c, k: c + F.when(k == new, 1).otherwise(0) - F.when(k == old, 1).otherwise(0))
            bits = F.when(i >= window - 1, F.lit(math.log2(window)) - total / F.lit(float(window))).otherwise(F.lit(0.0))
            return F.struct(counts.alias("counts"), total.alias("sum"), F.greatest(state["best"], bits).alias("best"))

        return F.aggregate(F.sequence(F.lit(0), F.size(codes) - 1), start, step, lambda state: state["best"])

    codes = F.transform(F.split(string, ""), lambda ch: F.instr(F.lit(alphabet), ch) - 1)
    return F.element_at(F.transform(F.array(codes), over), 1)  # binds the codes once


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW) -> DataFrame:
    """Per document: id, n_assign, n_access, n_hex, base_sha256, spans, n_entropy."""
    t = F.col("t")
    found = docs.select(F.col(id_col), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("t"))
    patterns = {"assign": ASSIGN, "access": ACCESS, "hex": HEX, "candidate": CANDIDATE}
    arrays = []
    for kind, pattern in patterns.items():
        arrays.append(_when_found(t, pattern, F.regexp_extract_all(t, F.lit(pattern), F.lit(0))).alias(f"{kind}_found"))
        arrays.append(_when_found(t, pattern, F.split(t, pattern, -1)).alias(f"{kind}_between"))
    arrays.append(_when_found(t, ASSIGN, F.regexp_extract_all(t, F.lit(ASSIGN), F.lit(2))).alias("assigned"))
    found = found.select(id_col, *arrays)
    none = F.array().cast("array<struct<start:bigint,end:bigint,match:string>>")

    def places(kind: str) -> Column:
        return F.when(F.col(f"{kind}_found").isNotNull(), _places(F.col(f"{kind}_found"), F.col(f"{kind}_between")))

    long_enough = F.zip_with(places("assign"), "assigned", lambda p, a: F.when(F.char_length(a) >= LEAST_ASSIGNED, p))
    located = found.select(
        id_col,
        F.coalesce(F.filter(long_enough, lambda p: p.isNotNull()), none).alias("assign"),
        *[F.coalesce(places(kind), none).alias(kind) for kind in ("access", "hex", "candidate")],
    )

    def ranked(kind: str) -> Column:
        k = KINDS.index(kind)
        return F.transform(kind, lambda p: F.struct(p["start"].alias("start"), F.lit(k).alias("kind"), p["end"].alias("end")))

    base = F.array_sort(F.concat(*[ranked(kind) for kind in KINDS[:3]]))
    located = located.select("*", base.alias("base"))

    def judged(p: Column) -> Column:
        is_hex = p["match"].rlike("^[0-9a-fA-F]+$")
        bits = F.when(is_hex, best_window(F.lower(p["match"]), HEX_DIGITS, window)).otherwise(best_window(p["match"], BASE64, window))
        least = F.when(is_hex, LEAST_BITS["entropy_hex"]).otherwise(LEAST_BITS["entropy_base64"])
        kind = F.when(is_hex, KINDS.index("entropy_hex")).otherwise(KINDS.index("entropy_base64"))
        return F.when(bits >= least, F.struct(p["start"].alias("start"), kind.alias("kind"), p["end"].alias("end")))

    unknown = F.filter(
        "candidate",
        lambda p: ~p["match"].rlike(ALLOWED) & ~F.exists("base", lambda b: (b["start"] < p["end"]) & (b["end"] > p["start"])),
    )
    entropy = F.filter(F.transform(unknown, judged), lambda p: p.isNotNull())
    located = located.select(
        id_col,
        *[F.size(kind).cast("long").alias(f"n_{kind}") for kind in KINDS[:3]],
        "base",
        F.when(F.size("candidate") > 0, entropy).otherwise(F.array().cast("array<struct<start:bigint,kind:int,end:bigint>>")).alias("more"),
    )
    names = F.array(*[F.lit(kind) for kind in KINDS])

    def joined(spans: Column) -> Column:
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")

    return located.select(
        id_col,
        "n_assign",
        "n_access",
        "n_hex",
        F.sha2(joined(F.col("base")), 256).alias("base_sha256"),
        joined(F.array_sort(F.concat("base", "more"))).alias("spans"),
        F.size("more").cast("long").alias("n_entropy"),
    )
