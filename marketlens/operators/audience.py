"""Audience selection: behaviour sets, tag groups and their combination.

Every behavioural tag names a set of members; the audience keeps (left semi join) or
drops (left anti join) the members of that set. A set is made distinct on the join key
first: the partial aggregation takes out members with very many rows before the
shuffle, and the join reuses the partitioning of that aggregation. Catalyst picks
broadcast or shuffle from the size it sees.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from marketlens.functions import predicates as P

AUDIENCE_COLUMNS = ("member_no", "mobile", "named", "device_cid", "device_type", "score_tag_result")

# Settled trade states and the two trade types.
SETTLED = (6, 9, 11)
SETTLED_OR_PENDING = (6, 8, 9, 11)
FIXED_TERM, CURRENT = 1, 2
FIRST_CURRENT_PRODUCT = 10000024


@dataclass
class Warehouse:
    """The tables an audience definition reads."""

    members: DataFrame
    issues: DataFrame | None = None
    uses: DataFrame | None = None
    trades: DataFrame | None = None
    products: DataFrame | None = None
    current_products: DataFrame | None = None
    white_lists: DataFrame | None = None  # member_no, white_list_group; where it is not given, a column of the members
    first_current_product: int = FIRST_CURRENT_PRODUCT


def keep_members(frame: DataFrame, chosen: DataFrame) -> DataFrame:
    return frame.join(chosen.select("member_no").distinct(), "member_no", "left_semi")


def drop_members(frame: DataFrame, chosen: DataFrame) -> DataFrame:
    return frame.join(chosen.select("member_no").distinct(), "member_no", "left_anti")


def issued(w: Warehouse, coupons: Sequence[int] | None, days: Sequence[tuple] | None) -> DataFrame:
    """Members who were issued one of the coupons inside the issue days."""
    rows = w.issues
    if coupons:
        rows = rows.filter(F.col("activity_coupon_id").isin(*coupons))
    if days:
        rows = rows.filter(P.in_date_ranges("create_time", days))
    return rows.select(F.col("user_id").alias("member_no"))


def used_all_issued(w: Warehouse, coupons: Sequence[int] | None, days: Sequence[tuple] | None) -> DataFrame:
    """Members whose count of issued coupons equals their count of used ones.

    The day ranges limit the uses only; issues count over all time. Both sides are
    aggregated before they meet.
    """
    given, used = w.issues, w.uses
    if coupons:
        given = given.filter(F.col("activity_coupon_id").isin(*coupons))
        used = used.filter(F.col("activity_coupon_id").isin(*coupons))
    bought = w.trades.filter(F.col("status").isin(*SETTLED) & (F.col("fund_trans_type") == FIXED_TERM))
    if days:
        bought = bought.filter(P.in_date_ranges("trans_time", days))
    given_counts = given.groupBy(F.col("user_id").alias("member_no")).agg(F.count(F.lit(1)).alias("issued_cnt"))
    used_counts = (
        bought.join(used, bought.business_order_item_no == used.order_no)
        .groupBy("member_no")
        .agg(F.count(F.lit(1)).alias("used_cnt"))
    )
    both = given_counts.join(used_counts, "member_no")
    return both.filter(F.col("issued_cnt") == F.col("used_cnt")).select("member_no")


def bought(w: Warehouse, words: Sequence[str] | None, days: Sequence[tuple] | None) -> DataFrame:
    """Members with a settled fixed-term trade of a product whose name holds one of the words."""
    rows = w.trades.filter(F.col("status").isin(*SETTLED) & (F.col("fund_trans_type") == FIXED_TERM))
    if days:
        rows = rows.filter(P.in_date_ranges("trans_time", days))
    named = w.products if not words else w.products.filter(P.contains_any("product_name", words))
    return rows.join(named.select("id"), rows.product_id == named.id).select("member_no")


def white_listed(w: Warehouse, groups: Sequence[str]) -> DataFrame:
    """Members whose comma list of white-list groups holds one of the groups."""
    table = w.members if w.white_lists is None else w.white_lists
    return table.filter(in_white_lists(groups)).select("member_no")


def in_white_lists(groups: Sequence[str]) -> Column:
    """The comma list of a row holds one of the groups; rows without a list hold none."""
    listed = F.arrays_overlap(F.split("white_list_group", ","), F.array(*[F.lit(str(g)) for g in groups]))
    return F.coalesce(listed, F.lit(False))


def fixed_term_due(w: Warehouse, days: Sequence[tuple]) -> DataFrame:
    """Holders of a fixed-term product that falls due in the days."""
    rows = w.trades.filter(F.col("status").isin(*SETTLED) & (F.col("fund_trans_type") == FIXED_TERM))
    due = w.products.filter(P.in_date_ranges("due_date", days)).select("id")
    return rows.join(due, rows.product_id == due.id).select("member_no")


def current_due(w: Warehouse, days: Sequence[tuple]) -> DataFrame:
    """Holders of a current product that falls due in the days."""
    rows = w.trades.filter(
        F.col("status").isin(*SETTLED_OR_PENDING)
        & (F.col("fund_trans_type") == CURRENT)
        & (F.col("product_id") >= w.first_current_product)
    )
    due = w.current_products.filter(P.in_date_ranges("due_date", days)).select("id")
    return rows.join(due, rows.product_id == due.id).select("member_no")


def best_by_score(frame: DataFrame, n: int, key: str = "member_no") -> DataFrame:
    """The n rows of the highest score; a hash of the key breaks ties the same way every time.

    Planned as a top-k per task followed by a merge of k rows, not as a full sort.
    """
    return frame.orderBy(F.col("score_tag_result").desc(), F.md5(F.col(key).cast("string").cast("binary")), key).limit(n)


def united(frames: Sequence[DataFrame]) -> DataFrame:
    """Union of groups; more than one group is made distinct over its columns."""
    if len(frames) == 1:
        return frames[0]
    return reduce(DataFrame.unionByName, frames).dropDuplicates()


def without_audiences(frame: DataFrame, audiences: Sequence[DataFrame]) -> DataFrame:
    if not audiences:
        return frame
    return drop_members(frame, reduce(DataFrame.unionByName, [a.select("member_no") for a in audiences]))


def within_audiences(frame: DataFrame, audiences: Sequence[DataFrame]) -> DataFrame:
    if not audiences:
        return frame
    return keep_members(frame, reduce(DataFrame.unionByName, [a.select("member_no") for a in audiences]))


@dataclass
class Tag:
    """One chosen tag: ``type`` is the tag type 0..21, ``values`` its choices."""

    type: int
    values: Sequence = ()
    field: str | None = None


@dataclass
class Group:
    tags: list[Tag] = field(default_factory=list)


# Tag types that share a derived set: the id or word list and its day ranges.
_SETS = {
    "not_issued": (5, 6), "issued": (7, 8), "not_used_all": (9, 10), "used_all": (11, 12),
    "not_bought": (13, 14), "bought": (15, 16),
}
_SET_OPERATORS = {
    "not_issued": (issued, drop_members), "issued": (issued, keep_members),
    "not_used_all": (used_all_issued, drop_members), "used_all": (used_all_issued, keep_members),
    "not_bought": (bought, drop_members), "bought": (bought, keep_members),
}
_SINGLE_OPERATORS = {
    17: (white_listed, keep_members), 18: (white_listed, drop_members),
    20: (fixed_term_due, keep_members), 21: (current_due, keep_members),
}


def _wide_table_terms(tags: Sequence[Tag]) -> tuple[list[Column], list[Column]]:
    terms, null_terms = [], []
    for tag in tags:
        if tag.type == 0:
            null_terms.append(P.is_missing(tag.field))
        elif tag.type == 1:
            values = [v for v in tag.values if not (tag.field == "sex" and v == P.UNKNOWN_SEX)]
            unknown = len(values) < len(tag.values)
            if unknown and not values:
                null_terms.append(P.is_missing(tag.field))
            else:
                term = P.equals_any(tag.field, values)
                terms.append(term | P.is_missing(tag.field) if unknown else term)
        elif tag.type == 2:
            terms.append(P.equals_any(tag.field, [v for text in tag.values for v in P.comma_values(str(text))]))
        elif tag.type == 3:
            terms.append(P.in_ranges(tag.field, tag.values))
        elif tag.type == 4:
            terms.append(P.in_date_ranges(tag.field, tag.values))
    return terms, null_terms


def group_members(w: Warehouse, group: Group) -> DataFrame:
    """Members of one tag group, with the six audience columns."""
    predicate = P.group_predicate(*_wide_table_terms(group.tags))
    frame = w.members if predicate is None else w.members.filter(predicate)
    given = {tag.type: tag for tag in group.tags}
    if w.white_lists is None:  # the lists are a column of the members, so this is a test of their own row
        for kind in (17, 18):
            if kind in given:
                listed = in_white_lists(given.pop(kind).values)
                frame = frame.filter(listed if kind == 17 else ~listed)
    frame = frame.select(*AUDIENCE_COLUMNS)
    for name, (list_type, day_type) in _SETS.items():
        if list_type in given or day_type in given:
            chosen, combine = _SET_OPERATORS[name]
            choices = given[list_type].values if list_type in given else None
            days = given[day_type].values if day_type in given else None
            frame = combine(frame, chosen(w, choices, days))
    for kind, (chosen, combine) in _SINGLE_OPERATORS.items():
        if kind in given:
            frame = combine(frame, chosen(w, given[kind].values))
    if 19 in given:
        frame = best_by_score(frame, int(given[19].values[0]))
    return frame


def audience(
    w: Warehouse, groups: Sequence[Group], excluded: Sequence[DataFrame] = (), included: Sequence[DataFrame] = ()
) -> DataFrame:
    """A whole audience definition as one DataFrame."""
    frame = united([group_members(w, g) for g in groups])
    return within_audiences(without_audiences(frame, excluded), included)
