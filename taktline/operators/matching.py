"""Conservative name match between two operator lists.

Classes: A equal raw names, B equal normal forms, C reviewed alias, D similar
names only (never accepted), E nothing similar. A name that several companies
share is never decided by name.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import Column, DataFrame, Window, functions as F

from taktline.constants import FUZZY_THRESHOLD, FUZZY_TOP_K
from taktline.functions import normalize_name, seq_ratio_from, strip
from taktline.workspace import Lazy, Workspace

LINK = ("links_operator_id", "operator_name", "prefecture_address", "operator_number", "source_rows")


def _with_key(df: DataFrame, name: str) -> DataFrame:
    return df.withColumn("name", strip(F.coalesce(name, F.lit("")))).withColumn(
        "key", normalize_name(F.col("name"))
    )


def unique_names(links: DataFrame, by: str) -> DataFrame:
    """Per name: does it name one company, and the first row of it."""
    return links.where("name <> ''").groupBy(by).agg(
        (F.min("links_operator_id") == F.max("links_operator_id")).alias("single"),
        F.min_by(F.struct(*LINK), "row_ix").alias("link"),
    )


# -- similar names ------------------------------------------------------------


DEPTHS = (1, 3, 5)  # characters of a signature
PAIR_COST = 8  # rows of longer signatures that a pair is worth


def _least_overlap(a: Column, b: Column, threshold: float) -> Column:
    """Characters two names of these lengths must share to reach the ratio."""
    return F.ceil((a + b) * (threshold / 2) - 1e-9).cast("int")


def _by_rarity(keys: DataFrame, frequency: DataFrame, threshold: float) -> DataFrame:
    """Per key its characters (c) and places (p), the rarest first, and the least overlap with any partner."""
    spread = keys.select("key", F.length("key").alias("n"), F.posexplode(F.split("key", "")).alias("p", "c")).where("c <> ''")
    order = F.sort_array(F.collect_list(F.struct("freq", "c", "p")))  # as long as the name
    shortest = threshold / (2 - threshold)
    return spread.join(frequency, "c").groupBy("key", "n").agg(order.alias("order")).withColumn(
        "least", F.greatest(F.lit(1), _least_overlap(F.col("n"), F.ceil(F.col("n") * shortest - 1e-9), threshold)))


def _room(n: Column | str, least: Column | str, depth: int) -> Column:
    """Rarest characters among which ``depth`` shared ones stand, whatever the partner."""
    return F.col(n) - F.greatest(F.col(least), F.lit(depth)) + depth


def _longer(rows: DataFrame, ordered: DataFrame, depth: int, rest: int) -> DataFrame:
    """Signatures with one more character, rarer than none before; ``rest`` more are to follow up to ``depth``."""
    free = rows.select("key", "j", "marks").join(ordered, "key").withColumn("_room", _room("n", "least", depth) - rest).where("j < _room")
    return free.select(
        "key", "n", "least", F.explode(F.sequence(F.col("j") + 1, F.col("_room"))).alias("j"), "marks", "order"
    ).withColumn("_mark", F.element_at("order", F.col("j"))).select(
        "key", "n", "least", "j", F.array_sort(F.array_append("marks", F.struct("_mark.p", "_mark.c"))).alias("marks"))


def _signed(rows: DataFrame) -> DataFrame:
    """The signature: characters in the order of the name; and how many others stand between them."""
    ends = F.concat(F.array(F.lit(-1)), F.transform("marks", lambda m: m["p"]), F.array("n"))
    gaps = F.zip_with(F.slice(ends, 2, F.size(ends) - 1), F.slice(ends, 1, F.size(ends) - 1), lambda b, a: b - a - 1)
    return rows.withColumns({"sign": F.array_join(F.transform("marks", lambda m: m["c"]), ""), "gaps": gaps})


def _candidates(left: DataFrame, right: DataFrame, depth: int, following: int, threshold: float) -> DataFrame:
    """Pairs with one signature whose lengths and places leave room for the overlap they need."""
    sides = [x.select("sign", "crowded", *[F.col(c).alias(f"{s}_{c}") for c in ("key", "n", "j", "gaps")]) for s, x in (("l", left), ("r", right))]
    need = _least_overlap(F.col("l_n"), F.col("r_n"), threshold)
    between = F.aggregate(F.zip_with("l_gaps", "r_gaps", lambda a, b: F.least(a, b)), F.lit(0), lambda x, y: x + y)
    fits = (need <= F.least("l_n", "r_n")) & (F.col("l_j") <= F.col("l_n") - need + depth) & (F.col("r_j") <= F.col("r_n") - need + depth)
    turn = (need >= depth) & (~F.col("crowded") | (need < following))
    return sides[0].join(sides[1], ["sign", "crowded"]).where(fits & turn & (between + depth >= need)).select(
        F.col("l_key").alias("l"), F.col("r_key").alias("r"))


def candidate_keys(left: DataFrame, right: DataFrame, threshold: float = FUZZY_THRESHOLD, workspace: Workspace | Lazy = Lazy()) -> DataFrame:
    """Pairs of distinct keys that may reach the ratio, some of them several times.

    The blocks that the ratio counts are a common subsequence. So the ``d`` rarest characters of it, any ``d`` up to the
    overlap that is needed, stand in both names in the same order and among the rarest characters of either. These
    characters are a signature, by which names meet. A signature is short where few names have it; where joining its
    names would cost more than longer signatures would, these take its place (``DEPTHS``). The steps are always written,
    since each is read several times.
    """
    if isinstance(workspace, Lazy):
        workspace = Workspace(left.sparkSession)
    sides = {"l": left, "r": right}
    keys = {s: workspace.keep(df.select("key").where("key <> ''").distinct(), f"keys-{s}") for s, df in sides.items()}
    chars = [df.select(F.explode(F.array_distinct(F.split("key", ""))).alias("c")) for df in keys.values()]
    frequency = chars[0].unionAll(chars[1]).groupBy("c").agg(F.count("*").alias("freq"))
    ordered = {s: workspace.keep(_by_rarity(df, frequency, threshold), f"order-{s}") for s, df in keys.items()}
    empty = F.array().cast("array<struct<p: int, c: string>>")
    rows = {s: df.select("key", F.lit(0).alias("j"), empty.alias("marks")) for s, df in ordered.items()}
    pairs, had = [], 0
    for depth, following in zip(DEPTHS, (*DEPTHS[1:], None)):
        for rest in reversed(range(depth - had)):
            rows = {s: _longer(rows[s], ordered[s], depth, rest) for s in sides}
        signed, had = {s: _signed(df) for s, df in rows.items()}, depth
        if following:
            free = _room("n", "least", following) - F.col("j")
            more = F.when(free >= following - depth, free * (free - 1) / 2).otherwise(0)  # two characters are added
            signed = {s: workspace.keep(df, f"signed-{depth}-{s}") for s, df in signed.items()}
            size = {s: df.groupBy("sign").agg(F.count("*").alias(f"n_{s}"), F.sum(more).alias(f"more_{s}")) for s, df in signed.items()}
            crowded = F.col("n_l") * F.col("n_r") * PAIR_COST > F.col("more_l") + F.col("more_r")
            stats = size["l"].join(size["r"], "sign").select("sign", crowded.alias("crowded"))
            signed = {s: df.join(stats, "sign") for s, df in signed.items()}
            rows = {s: df.where("crowded") for s, df in signed.items()}
            # Of a crowded signature only pairs that need fewer characters than the next ones have are taken here.
            signed = {s: df.where(~F.col("crowded") | (F.col("least") < following)) for s, df in signed.items()}
        else:
            signed = {s: df.withColumn("crowded", F.lit(False)) for s, df in signed.items()}
        pairs.append(_candidates(signed["l"], signed["r"], depth, following or 0, threshold))
    out = pairs[0]
    for more_pairs in pairs[1:]:
        out = out.unionByName(more_pairs)
    return out


def similar_keys(
    left: DataFrame, right: DataFrame, threshold: float = FUZZY_THRESHOLD, workspace: Workspace | Lazy = Lazy()
) -> DataFrame:
    """All pairs of distinct keys with a ratio of at least ``threshold``.

    Exact: each step before the ratio only removes pairs that cannot reach it.
    """
    pairs = candidate_keys(left, right, threshold, workspace).distinct()
    # Declared non-deterministic, or the filter would compute the ratio again.
    ratio = seq_ratio_from(threshold).asNondeterministic()
    return pairs.select("l", "r", ratio(F.col("l"), F.col("r")).alias("score")).where(F.col("score") >= threshold)


def match_fuzzy(
    operators: DataFrame, links: DataFrame, threshold: float = FUZZY_THRESHOLD, k: int = FUZZY_TOP_K,
    workspace: Workspace | Lazy = Lazy(),
) -> DataFrame:
    """The ``k`` most similar companies of an operator, for review only.

    Similarity is a matter of distinct keys. A key stands for at most ``k`` of
    its companies, since the others come later in the ranking anyway.
    """
    per_key = Window.partitionBy("key").orderBy("operator_name", "row_ix")
    best_links = links.where("name <> ''").withColumn("_n", F.row_number().over(per_key)).where(
        F.col("_n") <= k
    ).select(F.col("key").alias("r"), *LINK, "row_ix")
    ranked = Window.partitionBy("l").orderBy(F.desc("score"), "operator_name", "row_ix")
    top = similar_keys(operators, links, threshold, workspace).join(best_links, "r").withColumn(
        "rank", F.row_number().over(ranked)
    ).where(F.col("rank") <= k).withColumnRenamed("l", "key")
    return operators.join(top.drop("r", "row_ix"), "key")


class Matching:
    """The match cascade; every result is a plan over the same resolved table.

    ``operators``: operator_id, agency_name, agency_url, prefectures.
    ``links``: rows of the company rollup with ``row_ix``; None when the source
    was not obtained, which makes every result unknown rather than zero.
    ``aliases``: approved aliases with ``row_ix``.
    """

    def __init__(
        self, operators: DataFrame, links: DataFrame | None, aliases: DataFrame | None = None,
        workspace: Workspace | Lazy = Lazy(),
    ):
        self.available = links is not None
        self.workspace = workspace
        self._operators = operators
        self._links = links
        self.aliases = aliases

    @cached_property
    def operators(self) -> DataFrame:
        """Operators with trimmed name and normal form."""
        columns = self._operators.select("operator_id", "agency_name", "agency_url", "prefectures")
        return self.workspace.keep(_with_key(columns, "agency_name"), "operator_names")

    @cached_property
    def links(self) -> DataFrame:
        """Companies with trimmed name and normal form."""
        return self.workspace.keep(_with_key(self._links, "operator_name"), "company_names")

    @cached_property
    def by_name(self) -> DataFrame:
        """Operators with what exact and normalised equality say."""
        exact = unique_names(self.links, "name").withColumnsRenamed({"single": "exact_single", "link": "exact"})
        normal = unique_names(self.links, "key").withColumnsRenamed({"single": "normal_single", "link": "normal"})
        return self.operators.join(exact, "name", "left").join(normal, "key", "left")

    def match_exact(self) -> DataFrame:
        """Class A."""
        return self.by_name.where("exact_single").select("operator_id", "exact.links_operator_id")

    def match_normalized(self) -> DataFrame:
        """Class B."""
        return self.by_name.where("exact IS NULL AND normal_single").select(
            "operator_id", "normal.links_operator_id"
        )

    def match_alias(self) -> DataFrame:
        """First approved alias of an operator whose company exists."""
        company = self.links.groupBy("links_operator_id").agg(F.min_by(F.struct(*LINK), "row_ix").alias("alias"))
        return self.aliases.select("operator_id", "links_operator_id", F.col("row_ix").alias("alias_ix")).join(
            company, "links_operator_id"
        ).groupBy("operator_id").agg(F.min_by("alias", "alias_ix").alias("alias"))

    @cached_property
    def _named(self) -> DataFrame:
        """Operators with their class as far as names and aliases decide it."""
        named = self.by_name
        if self.aliases is not None:
            named = named.join(self.match_alias(), "operator_id", "left")
        else:
            named = named.withColumn("alias", F.lit(None).cast(named.schema["exact"].dataType))
        neither = F.col("exact").isNull() & F.col("normal").isNull()
        name_class = (
            F.when(F.col("exact_single"), "A")
            .when(F.col("exact").isNull() & F.col("normal_single"), "B")
            .when(neither & F.col("alias").isNotNull(), "C")
        )
        link = (
            F.when(F.col("name_class") == "A", F.col("exact"))
            .when(F.col("name_class") == "B", F.col("normal"))
            .when(F.col("name_class") == "C", F.col("alias"))
        )
        resolved = named.withColumn("name_class", name_class).select(
            "operator_id", "agency_name", "agency_url", "prefectures", "name", "key", "name_class",
            link.alias("link"),
            F.when(~F.col("exact_single"), "exact").when(
                F.col("exact").isNull() & ~F.col("normal_single"), "normalized"
            ).alias("ambiguous_by"),
        )
        return self.workspace.keep(resolved, "matched_names")

    @cached_property
    def similar(self) -> DataFrame:
        """Similar companies of the operators that names did not decide."""
        open_ones = self._named.where("name_class IS NULL AND key <> ''")
        return self.workspace.keep(match_fuzzy(open_ones, self.links, workspace=self.workspace), "similar_names")

    @cached_property
    def classes(self) -> DataFrame:
        """Every operator with its class."""
        if not self.available:
            return self.operators.withColumns(
                {"match_class": F.lit("not_evaluable"), "link": F.lit(None).cast("string")}
            )
        found = self.similar.select("operator_id").distinct().withColumn("_similar", F.lit(True))
        return self._named.join(found, "operator_id", "left").withColumn(
            "match_class", F.coalesce("name_class", F.when(F.col("_similar"), "D").otherwise("E"))
        ).drop("_similar")

    def match_ambiguous(self) -> DataFrame:
        """Companies that share the name of an operator, all of them."""
        rows = []
        for kind, by in (("exact", "name"), ("normalized", "key")):
            open_ones = self._named.where(F.col("ambiguous_by") == kind).select(
                "operator_id", F.col("name").alias("agency_name"), by
            )
            rows.append(
                open_ones.join(self.links.where("name <> ''"), by).select(
                    "operator_id", open_ones.agency_name,
                    F.col("links_operator_id").alias("candidate_links_operator_id"),
                    F.col("operator_name").alias("candidate_links_name"), F.lit(1.0).alias("score"),
                    F.lit(f"{kind}_name_ambiguous_multiple_LINKS_entities").alias("candidate_type"),
                    F.lit(False).alias("auto_accepted"),
                )
            )
        return rows[0].unionByName(rows[1])

    def fuzzy_candidates(self) -> DataFrame:
        """Everything a reviewer has to look at; nothing of it is accepted."""
        similar = self.similar.select(
            "operator_id", F.col("name").alias("agency_name"), "agency_url", "prefectures",
            F.col("links_operator_id").alias("candidate_links_operator_id"),
            F.col("operator_name").alias("candidate_links_name"),
            F.col("prefecture_address").alias("candidate_location"),
            F.round("score", 4).alias("score"),
            F.lit("fuzzy_review_required").alias("candidate_type"), F.lit(False).alias("auto_accepted"),
        )
        return similar.unionByName(self.match_ambiguous(), allowMissingColumns=True)

    def matched_operators(self) -> DataFrame:
        """Confirmed matches: classes A, B and C."""
        basis = (
            F.when(F.col("name_class") == "A", "raw agency_name equals LINKS operator_name")
            .when(F.col("name_class") == "B", "NFKC/whitespace/legal-form normalized name equality")
            .otherwise("manually reviewed alias; evidence and location validation supplied")
        )
        return self._named.where("name_class IS NOT NULL").select(
            "operator_id", F.col("name").alias("gtfs_agency_name"), "agency_url",
            F.col("prefectures").alias("gtfs_prefectures"),
            "link.links_operator_id", F.col("link.operator_name").alias("links_operator_name"),
            F.col("link.prefecture_address").alias("links_location"),
            F.col("link.operator_number").alias("links_operator_number"),
            F.col("name_class").alias("match_class"), basis.alias("match_basis"),
            F.lit("unique name candidate; C alias additionally reviewed").alias("link_validation"),
            "link.source_rows",
        )

    def unmatched_left(self) -> DataFrame:
        """Operators without a confirmed company, and why."""
        reason = (
            F.when(F.col("match_class") == "D", "fuzzy candidate(s) exist; no automatic acceptance")
            .when(F.col("match_class") == "E", "no exact, normalized, approved-alias, or fuzzy candidate")
            .otherwise("official LINKS raw files were not acquired; this is not Match E")
        )
        return self.classes.where(F.col("match_class").isin("D", "E", "not_evaluable")).select(
            "operator_id", F.col("name").alias("agency_name"), "agency_url", "prefectures", "match_class",
            reason.alias("reason"),
        )

    def unmatched_right(self) -> DataFrame:
        """Companies no operator was confirmed for."""
        if not self.available:
            return self.operators.sparkSession.range(1).select(
                F.lit("not_evaluable").alias("status"),
                F.lit("LINKS source rows not acquired; no national unmatched LINKS count can be calculated")
                .alias("reason"),
            )
        confirmed = self._named.where("link IS NOT NULL").select("link.links_operator_id").distinct()
        return self.links.drop("name", "key").join(confirmed, "links_operator_id", "left_anti").withColumn(
            "reason", F.lit("not confirmed as a GTFS bus agency match")
        )

    def match_summary(self) -> DataFrame:
        """Operators per class; NULL, not zero, when the source is missing."""
        notes = {
            "A": "raw exact name", "B": "normalized exact name", "C": "manual approved alias",
            "D": "fuzzy candidates only, not accepted", "E": "no candidate after a complete LINKS comparison",
        }
        status = "measured" if self.available else "not_evaluable_LINKS_data_unavailable"
        counts = self.classes.agg(
            F.count("*").alias("total"), *[F.count_if(F.col("match_class") == c).alias(c) for c in notes]
        )
        rows = [
            F.struct(
                F.lit(c).alias("match_class"),
                (F.col(c) if self.available else F.lit(None).cast("bigint")).alias("confirmed_or_candidate_count"),
                F.lit(status).alias("status"), F.lit(note).alias("note"),
            )
            for c, note in notes.items()
        ]
        rows.append(
            F.struct(
                F.lit("GTFS_total").alias("match_class"), F.col("total").alias("confirmed_or_candidate_count"),
                F.lit("measured_from_internal_GTFS_agency_names").alias("status"),
                F.lit("Canonical entities across current GTFS feeds, not feed count").alias("note"),
            )
        )
        return counts.select(F.inline(F.array(*rows)))
