"""Column functions over cell texts and labels. All are built-in expressions; none needs Python in the workers."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Patterns of the cell grammar.
MISSING_CORE = r"^[\-‒–—―�\s*]*$"
MISSING_WORD = r"^(n/?a|n\.a\.?|nm|nil|--+)$"
NUMBER = r"^-?[0-9]+(\.[0-9]+)?$"
FLOAT = r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$"
TOTAL = r"(?iU)\b(total|subtotal|aggregate)\b"
THRESHOLD_WORDS = r"(?iU)\b(while|under|at least|at most|below|above|exceed|exceeds|less than|greater than|no more than|no less than|of at least|of at most)\b"
TRADEOFF_WORDS = r"(?iU)\b(pareto|trade-?off|optimal|optimize|optimise|maxim|minim)\b"
SUPERLATIVE_HIGH = ("largest", "highest", "greatest", "most", "maximum", "max", "biggest", "longest", "top")
SUPERLATIVE_LOW = ("lowest", "smallest", "least", "minimum", "min", "fewest", "shortest")


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is computed once, however often it is named."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def strip(c: Column) -> Column:
    """``c`` without surrounding white space of any script."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def is_missing(c: Column) -> Column:
    """Whether a cell writes that there is no value: empty, lone dashes, n/a and the like."""
    t = strip(F.regexp_replace(c, "[$%]", ""))
    return t.rlike("(?U)" + MISSING_CORE) | t.rlike("(?i)" + MISSING_WORD)


def cell_number(c: Column) -> Column:
    """The number that a cell writes, or null: one chain of replacements, so that it stays small within other expressions.

    Currency and percent signs and thousands commas go, parentheses mean a negative; a minus inside parentheses negates
    once more.
    """
    bare = F.regexp_replace(F.regexp_replace(c, "[$%]", ""), r"(?U)^\s+|\s+$|,", "")
    signed = F.regexp_replace(F.regexp_replace(bare, r"(?U)^\(\s*(.*?)\s*\)$", "-$1"), "^--", "")
    return F.regexp_extract(signed, NUMBER, 0).try_cast("double")


def parse_cell(c: Column) -> Column:
    """A messy cell as ``struct(kind, num, txt)``: kind is empty, int, float or str. What is no number keeps its own text; null is empty."""
    raw = strip(F.coalesce(c, F.lit("")))
    num = cell_number(c)
    kind = F.when(F.coalesce(is_missing(c), F.lit(True)), "empty").when(num.isNull(), "str").when(num == F.floor(num), "int").otherwise("float")
    return F.struct(kind.alias("kind"), num.alias("num"), F.when(kind == "empty", "").otherwise(raw).alias("txt"))


def is_year(num: Column) -> Column:
    """Whether a number can be a year of the 20th or 21st century."""
    return (num == F.floor(num)) & num.between(1900, 2099)


def starts_with_year(c: Column) -> Column:
    return c.rlike(r"^(19|20)[0-9]{2}\b")


def year_of(c: Column) -> Column:
    """The first year that a text names, or null."""
    y = F.regexp_extract(c, "(19|20)[0-9]{2}", 0)
    return F.when(y != "", y)


def is_total(label: Column) -> Column:
    return F.coalesce(label, F.lit("")).rlike(TOTAL)


def canon_num(c: Column) -> Column:
    """The number that a value writes in any notation, with percents as fractions; null if it writes none."""
    t = strip(c)
    negative = t.startswith("(") & t.endswith(")")
    t = F.regexp_replace(t, r"^[()]+|[()]+$", "")
    t = strip(F.regexp_replace(t, "(?i)[$£€¥,]|RMB|USD|GBP|EUR", ""))
    percent = t.endswith("%")
    body = strip(F.regexp_replace(t, "%+$", ""))
    v = F.when(body.rlike(FLOAT), body).try_cast("double")
    v = F.when(percent, v / 100).otherwise(v)
    return F.when(negative, -v).otherwise(v)


def fmt_equiv(a: Column, b: Column) -> Column:
    """Whether two values are equal apart from their format."""
    x, y = canon_num(a), canon_num(b)
    return F.when(x.isNotNull() & y.isNotNull(), F.abs(x - y) <= 1e-6).otherwise(F.coalesce(strip(a) == strip(b), F.lit(False)))


def norm_label(c: Column) -> Column:
    """A label for comparison: white space collapsed, lower case, without surrounding punctuation."""
    return F.regexp_replace(F.lower(F.regexp_replace(strip(c), r"(?U)\s+", " ")), r"^[ .,:;]+|[ .,:;]+$", "")


def norm_words(c: Column) -> Column:
    """A text in lower case with single blanks for all that is no letter or digit."""
    return F.trim(F.regexp_replace(F.lower(c), "[^a-z0-9]+", " "))


def base_table_id(c: Column) -> Column:
    return F.regexp_replace(c, "_(rows|cols)$", "")


def _scaled_half_even(a: Column, b: Column) -> Column:
    """The whole number nearest to ``a * b`` as by exact arithmetic, the even one of two; both factors below 2 ** 500.

    The product's rounding error is found by splitting the factors into halves of their digits, so that a number such as
    2.675, which lies a little below its decimal text, is no tie.
    """
    half = lambda x: 134217729.0 * x - (134217729.0 * x - x)
    parts = F.struct(
        a.alias("a"),
        half(a).alias("ah"),
        b.alias("b"),
        half(b).alias("bh"),
        (a * b).alias("hi"),
        F.floor(a * b).cast("double").alias("low")
    )

    def near(x: Column) -> Column:
        al, bl = x["a"] - x["ah"], x["b"] - x["bh"]
        lost = ((x["ah"] * x["bh"] - x["hi"]) + x["ah"] * bl + al * x["bh"]) + al * bl
        return let(
            (x["hi"] - x["low"] - 0.5) + lost,
            lambda over: x["low"] + F.when(over > 0, 1.0).when(over < 0, 0.0).otherwise(F.abs(x["low"]) % 2)
        )

    return let(parts, near)


def general_format(num: Column) -> Column:
    """A number in at most six significant digits without trailing zeros, with an exponent below -4 and from 6 on."""
    trim = lambda s: F.when(s.contains("."), F.regexp_replace(s, r"\.?0+$", "")).otherwise(s)

    def shown(x: Column) -> Column:
        e = F.when(x["a"] == 0, F.lit(0)).otherwise(F.regexp_extract(x["digits"], r"e([+-][0-9]+)$", 1).cast("int"))
        return let(
            F.struct(x["a"].alias("a"), x["digits"].alias("digits"), e.alias("e"), F.least(F.greatest(F.lit(0), 5 - e), F.lit(9)).alias("places")),
            placed
        )

    def placed(x: Column) -> Column:
        tens = F.element_at(F.array(*(F.lit(10.0**k) for k in range(10))), x["places"] + 1)
        return let(_scaled_half_even(x["a"], tens), lambda whole: written(x, whole))

    def written(x: Column, whole: Column) -> Column:
        scientific = F.concat(
            trim(F.regexp_extract(x["digits"], r"^([0-9.]+)e", 1)),
            F.when(x["e"] < 0, "e-").otherwise("e+"),
            F.lpad(F.abs(x["e"]).cast("string"), 2, "0")
        )
        fixed = F.lit(None).cast("string")
        for k in range(9, -1, -1):
            fixed = F.when(x["places"] == k, F.format_string(f"%.{k}f", whole / 10.0**k)).otherwise(fixed)
        return F.when((x["e"] < -4) | (x["e"] >= 6), scientific).when((x["places"] == 0) & (whole >= 1e6), "1e+06").otherwise(trim(fixed))

    out = let(F.struct(F.abs(num).alias("a"), F.format_string("%.5e", F.abs(num)).alias("digits")), shown)
    return F.when(num.isNotNull(), F.when(num < 0, F.concat(F.lit("-"), out)).otherwise(out))


def superlative_direction(question: Column) -> Column:
    """higher or lower by the superlative that a question uses, else null."""
    words = F.split(norm_words(question), " ")
    return F.when(
        F.arrays_overlap(words, F.array(*map(F.lit, SUPERLATIVE_HIGH))),
        "higher"
    ).when(F.arrays_overlap(words, F.array(*map(F.lit, SUPERLATIVE_LOW))), "lower")


def chain_values(chain: Column) -> Column:
    """The numbers of a chain such as ``9>8>7``; null where the comparison signs are mixed or absent, or a part is no number."""
    up, down = chain.contains("<"), chain.contains(">")
    parts = F.transform(F.split(chain, "[<>]"), cell_number)
    return F.when((up != down) & ~F.exists(parts, lambda x: x.isNull()), parts)


def gate_fires(op_type: Column, question: Column) -> Column:
    """Whether the safety gate rejects an operation: one whose question lacks its words, or one outside the vocabulary."""
    q = F.coalesce(question, F.lit(""))
    return F.coalesce(
        F.when(
            op_type.isin("best_under_constraint", "threshold_filter"),
            ~q.rlike(THRESHOLD_WORDS)
        ).when(op_type == "tradeoff_summary", ~q.rlike(TRADEOFF_WORDS)),
        F.lit(True)
    )


def canonical_op(c: Column) -> Column:
    """lt or gte for a known comparison, null for any other."""
    return F.when(c == "ge", "gte").when(c.isin("lt", "gte"), c)


def rendered(c: Column) -> Column:
    """A cell as it is shown: parsed, numbers in at most six significant digits but whole ones in full, missing values empty."""

    def shown(num: Column) -> Column:
        whole = (num == F.floor(num)) & (F.abs(num) < 9e18)
        return F.when(
            num.isNull(),
            F.when(F.coalesce(is_missing(c), F.lit(True)), "").otherwise(strip(c))
        ).when(whole, num.cast("bigint").cast("string")).otherwise(general_format(num))

    return let(cell_number(c), shown)
