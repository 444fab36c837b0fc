"""Column functions of evidence support, comparison scope and margins."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Support labels, from the strongest statement against comparison to exact.
RESTRICTED, TRUNCATED, DEGENERATE, PARTICLE, EXACT = (
    "restricted_support_difference", "truncated_full_grid", "degenerate_single_bin", "particle_approximation", "exact_full_grid",
)
UNKNOWN, NOT_SCORED = "unknown_noncomparable", "not_scored"
#: What scores of a support may be compared with.
COMPARISONS = {
    EXACT: "exact_model_evidence", TRUNCATED: "truncated_lower_bound", RESTRICTED: "restricted_support_difference",
    DEGENERATE: "degenerate_single_bin", PARTICLE: "particle_approximation", NOT_SCORED: "not_scored",
}
#: Models, and modes of state-space models, that are exact without a label; words for missing, true and false.
EXACT_MODELS = ("random", "stationary")
EXACT_MODES = (
    "stationary", "diffusion", "fragmented", "jump", "first-order-imm", "trajectory-imm-exact-sparse", "momentum-exact-sparse", "displacement-momentum", "displacement-imm", "goal",
)
MISSING = ("", "nan", "na", "n/a", "none", "null", "<na>")
TRUE_WORDS = ("1", "1.0", "true", "t", "yes", "y", "on")
FALSE_WORDS = ("", "0", "0.0", "false", "f", "no", "n", "off", "nan", "none", "null")


def is_missing(c: Column) -> Column:
    """Null, or text that stands for nothing."""
    return c.isNull() | F.lower(F.trim(c.cast("string"))).isin(*MISSING)


def succeeded(status: Column) -> Column:
    """A missing status counts as success."""
    return is_missing(status) | (F.lower(F.trim(status)) == "success")


def to_flag(c: Column, default: bool = False) -> Column:
    """A flag read from text or numbers; what is not understood is the default."""
    word = F.lower(F.trim(c.cast("string")))
    number = word.try_cast("double")
    return (
        F.when(c.isNull(), default).when(word.isin(*TRUE_WORDS), True).when(word.isin(*FALSE_WORDS), False)
        .when(number.isNull() | F.isnan(number) | (F.abs(number) == float("inf")), default).otherwise(number != 0)
    )


def support(status: Column, model: Column, labels: list[Column], heldout: bool = False, mode: Column | None = None) -> Column:
    """The support of a score: failed rows are not scored; labels go by precedence; without
    any, only models known to be exact are; all else is unknown, which is never comparable.

    A difference of two truncated sums is no bound, so a held-out truncated row is restricted.
    """
    known = F.lit("")
    for label in (EXACT, PARTICLE, DEGENERATE, TRUNCATED, RESTRICTED):
        held = F.lit(False)
        for c in labels:
            held = held | F.coalesce(F.trim(c) == label, F.lit(False))
        known = F.when(held, label).otherwise(known)
    if heldout:
        known = F.when(known == TRUNCATED, RESTRICTED).otherwise(known)
    exact = F.lower(F.trim(model)).isin(*EXACT_MODELS)
    if mode is not None:
        exact = exact | F.coalesce(F.lower(F.trim(mode)).isin(*EXACT_MODES), F.lit(False))
    return F.when(~succeeded(status), NOT_SCORED).when(known != "", known).when(exact, EXACT).otherwise(UNKNOWN)


def comparison(support_label: Column) -> Column:
    """What scores of a support may be compared with."""
    out = F.lit(UNKNOWN)
    for label, scope in COMPARISONS.items():
        out = F.when(support_label == label, scope).otherwise(out)
    return out


def finite(c: Column) -> Column:
    return c.isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf"))


def margin_category(margin: Column) -> Column:
    """tie to 1, weak to 3, strong to 10, else decisive; a margin that is not finite is missing."""
    return F.when(~finite(margin), "missing").when(margin <= 1, "tie").when(margin <= 3, "weak").when(margin <= 10, "strong").otherwise("decisive")


def margin_label(margin: Column) -> Column:
    """As margin_category, but an infinite lead is decisive and other values without size unknown."""
    return F.when(margin == float("inf"), "decisive").when(~finite(margin), "unknown").otherwise(margin_category(margin))


def rat_of(session: Column) -> Column:
    return F.split(session, "/")[0]


def rounded(c: Column, digits: int = 6) -> Column:
    """For reports: rounded, without a negative zero."""
    return F.round(c, digits) + F.lit(0.0)
