"""Secrets in whole texts: key formats, and strings whose sliding-window entropy is too high for prose.

Base kinds follow fixed formats. The entropy kind looks at candidate strings of WINDOW or more characters that no base
span covers. A candidate belongs to a character class (hex, or letters and digits with symbols). A window of WINDOW characters moves over it; the counts
of the characters in the window change by one arrival and one departure per step, and so does the sum of n log2 n from which
the entropy follows. A candidate is reported when its highest window entropy reaches its class's bound and no allow-list
pattern matches it. Everything is built-in functions over the row: no shuffle, no Python.

Defined cases: null is an empty text; without spans the strings are empty (the digest is that of no bytes); repeated rows are
reported each; the result holds the id and the columns named here only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sessionlake.llm.spans import count_kind, located, of_kind, overlaps, written

# fixed values: formats of the base kinds
ASSIGN = r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{14,}"
HEX = r"[0-9a-f]{16,}"
KINDS = ["assign", "access", "hex", "entropy"]

WINDOW = 20
CANDIDATE = r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{20,}+"
HEX_BITS, TEXT_BITS = 3.2, 3.8  # of at most log2(16) = 4 and log2(20) = 4.32
ALLOWED = (  # identifiers that look random but are public, and placeholders
    r"^[0-9a-fA-F]{8}(-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}$",
    r"(?i)example|sample|placeholder|changeme|dummy|abcdefgh|12345678",
    r"(.)\1{5,}",
    r"^[A-Za-z/_=+-]*$",
    r"^[0-9/_=+-]*$",
)


def window_entropy(candidate: Column, window: int = WINDOW) -> Column:
    """Highest Shannon entropy (bits a character) of any window of an ASCII string of at least `window` characters."""
    codes = F.transform(F.split(candidate, ""), lambda c: F.ascii(c))

    def weight(n: Column) -> Column:
        return F.when(n > 1, n * F.log2(n)).otherwise(F.lit(0.0))

    def step(state: Column, i: Column, code: Column) -> Column:
        new, old = F.get(code, i), F.when(i >= window, F.get(code, i - window)).otherwise(F.lit(-1))
        n_new, n_old = F.get(state["counts"], new), F.when(old >= 0, F.get(state["counts"], old)).otherwise(F.lit(0))
        moved = weight(n_new + 1) - weight(n_new) + F.when(old >= 0, weight(n_old - 1) - weight(n_old)).otherwise(F.lit(0.0))
        total = F.when(new == old, state["total"]).otherwise(state["total"] + moved)
        counts = F.transform(state["counts"], lambda n, at: n + (at == new).cast("int") - (at == old).cast("int"))
        full = F.when(i >= window - 1, F.least(state["low"], total)).otherwise(state["low"])
        return F.struct(counts.alias("counts"), total.alias("total"), full.alias("low"))

    start = F.struct(F.array_repeat(F.lit(0), 128).alias("counts"), F.lit(0.0).alias("total"), F.lit(float("inf")).alias("low"))
    low = F.transform(F.array(codes), lambda code: F.aggregate(F.sequence(F.lit(0), F.size(code) - 1), start, lambda s, i: step(s, i, code), lambda s: s["low"]))
    return F.log2(F.lit(float(window))) - F.get(low, F.lit(0)) / window


def find_secrets(docs: DataFrame, id_column: str = "doc_id", text: str = "text", allowed: tuple[str, ...] = ALLOWED) -> DataFrame:
    """id, base and all (array<struct<start, kind, end>>, kind an index of KINDS) for every row."""
    rows = docs.select(docs[f"`{id_column}`"].alias(id_column), F.coalesce(docs[f"`{text}`"], F.lit("")).alias("body"))
    assign = F.filter(located(F.col("body"), ASSIGN), lambda s: F.length(F.regexp_extract(s["match"], f"^{ASSIGN}$", 2)) >= 12)
    rows = rows.select(id_column, assign.alias("assign"), located(F.col("body"), ACCESS).alias("access"), located(F.col("body"), HEX).alias("hex"), located(F.col("body"), CANDIDATE).alias("candidates"))
    rows = rows.select(id_column, "candidates", F.concat(of_kind(F.col("assign"), 0), of_kind(F.col("access"), 1), of_kind(F.col("hex"), 2)).alias("base"))

    def suspicious(s: Column) -> Column:
        word = s["match"]
        open_ = ~overlaps(F.col("base"), s["start"], s["end"])
        for pattern in allowed:
            open_ = open_ & ~word.rlike(pattern)
        bits = F.when(word.rlike("^[0-9a-fA-F]*$"), F.lit(HEX_BITS)).otherwise(F.lit(TEXT_BITS))
        return F.when(open_, window_entropy(word) >= bits).otherwise(F.lit(False))

    extra = F.filter("candidates", suspicious)
    return rows.select(id_column, F.array_sort("base").alias("base"), F.array_sort(F.concat("base", of_kind(extra, 3))).alias("all"))


def secret_digests(found: DataFrame) -> DataFrame:
    return found.select("doc_id", count_kind(F.col("base"), 0).alias("n_assign"), count_kind(F.col("base"), 1).alias("n_access"), count_kind(F.col("base"), 2).alias("n_hex"),
                        F.sha2(written(F.col("base"), KINDS).cast("binary"), 256).alias("base_sha256"), written(F.col("all"), KINDS).alias("spans"))
