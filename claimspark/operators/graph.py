"""Structure of provider graphs: strongly connected rings, dense cores, likely equal texts."""

from __future__ import annotations

from datetime import date
from functools import reduce
from operator import add

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from claimspark.functions.periods import Tables, add_days, claims_in
from claimspark.functions.scratch import materialise, materialise_with
from claimspark.operators.network import connected_components, referral_edges, shared_patient_edges


def _kept(rows: DataFrame, label: str) -> tuple[DataFrame, int]:
    """``rows`` written, and how many they are."""
    stored, seen = materialise_with(rows, label, rows=F.count(F.lit(1)))
    return stored, seen["rows"]


# ---- rings


def _trimmed(edges: DataFrame, number: int) -> tuple[DataFrame, int]:
    """Edges without those that lie on no cycle because nothing leads to or from them.

    A round takes off all nodes without a way in or out; rounds go on while they remove a
    tenth of the edges. What they leave is found later, they only save work.
    """
    while number:
        into = edges.select(F.col("b").alias("a")).distinct()
        out_of = edges.select(F.col("a").alias("b")).distinct()
        left, rest = _kept(edges.join(into, "a", "left_semi").join(out_of, "b", "left_semi").select("a", "b"), "trimmed")
        edges, removed, number = left, number - rest, rest
        if 10 * removed < number or not removed:
            break
    return edges, number


def _reached(edges: DataFrame) -> DataFrame:
    """(node, color): the smallest node from which each node can be reached, itself included.

    Only nodes whose color fell in the last round tell their neighbours.
    """
    nodes = edges.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    colors, changed = _kept(nodes.select("node", F.col("node").alias("color"), F.lit(True).alias("fell")), "colors")
    while changed:
        told = colors.where("fell").join(edges, F.col("node") == F.col("a")).groupBy(F.col("b").alias("node")).agg(F.min("color").alias("told"))
        fell = F.coalesce(F.col("told") < F.col("color"), F.lit(False))
        stepped = colors.join(told, "node", "left").select("node", F.when(fell, F.col("told")).otherwise(F.col("color")).alias("color"), fell.alias("fell"))
        colors, seen = materialise_with(stepped, "colors", fell=F.coalesce(F.sum(F.col("fell").cast("long")), F.lit(0)))
        changed = seen["fell"]
    return colors.select("node", "color")


def _returning(edges: DataFrame, colors: DataFrame) -> DataFrame:
    """(node, component): of each color the nodes that can reach the node that it is named after."""
    own = colors.withColumnRenamed("node", "a").withColumnRenamed("color", "color_a")
    other = colors.withColumnRenamed("node", "b").withColumnRenamed("color", "color_b")
    inner = edges.join(own, "a").join(other, "b").where("color_a = color_b").select("a", "b")
    inner = materialise(inner, "inner_edges")
    found, fresh = _kept(colors.where("node = color").select("node", F.col("color").alias("component"), F.lit(True).alias("fresh")), "returning")
    while fresh:
        step = found.where("fresh").join(inner, F.col("node") == F.col("b")).select(F.col("a").alias("node"), "component")
        new = step.distinct().join(found, "node", "left_anti").withColumn("fresh", F.lit(True))
        old = found.withColumn("fresh", F.lit(False))
        found, seen = materialise_with(old.unionByName(new), "returning", fresh=F.coalesce(F.sum(F.col("fresh").cast("long")), F.lit(0)))
        fresh = seen["fresh"]
    return found.select("node", "component")


def strong_components(edges: DataFrame, source: str, target: str) -> DataFrame:
    """(node, component) of all nodes that lie on a cycle of two or more: the smallest node on such a cycle with it.

    Edges on no cycle are trimmed first. Then each round colors nodes by the smallest node
    that reaches them; those that also reach it are one component, so a round settles at least
    one component of every color. Edges between colors or to settled nodes go, and the rest is
    the next round's graph. Every step is a written table, and counts are all that comes back.
    The rounds inside a step are as many as the longest shortest path has edges.
    """
    named = edges.select(F.col(source).alias("a"), F.col(target).alias("b"))
    live, number = _kept(named.where("a is not null and b is not null and a <> b").distinct(), "directed_edges")
    settled: list[DataFrame] = []
    empty = live.select(F.col("a").alias("node"), F.col("a").alias("component")).limit(0)
    while True:
        live, number = _trimmed(live, number)
        if not number:
            break
        colors = _reached(live)
        found = _returning(live, colors)
        settled.append(found)
        left = colors.join(found, "node", "left_anti")
        rest = live.join(left.withColumnRenamed("node", "a").withColumnRenamed("color", "color_a"), "a")
        rest = rest.join(left.withColumnRenamed("node", "b").withColumnRenamed("color", "color_b"), "b").where("color_a = color_b")
        live, number = _kept(rest.select("a", "b"), "directed_edges")
    for part in settled:
        empty = empty.unionByName(part)
    several = empty.groupBy("component").agg(F.count(F.lit(1)).alias("size")).where("size > 1")
    return empty.join(several, "component", "left_semi").select("node", "component")


def referral_rings(
    tables: Tables, start: date | str, end: date | str, *, min_referrals: int = 1, min_size: int = 2
) -> DataFrame:
    """Providers whose referrals come back to them, directly or through others.

    (provider_npi, ring, ring_size, ring_referrals): rings are the strongly connected
    components of the referrals made at least ``min_referrals`` times, named after their
    smallest provider; ``ring_referrals`` counts the referrals between different members.
    """
    edges = referral_edges(tables, start, end).where(F.col("referral_count") >= min_referrals)
    edges = materialise(edges.select("referring_npi", "rendering_npi", "referral_count"), "referrals")
    members = strong_components(edges, "referring_npi", "rendering_npi")
    one = members.select(F.col("node").alias("referring_npi"), F.col("component").alias("ring"))
    two = members.select(F.col("node").alias("rendering_npi"), F.col("component").alias("other_ring"))
    inside = edges.where("referring_npi <> rendering_npi").join(one, "referring_npi").join(two, "rendering_npi").where("ring = other_ring")
    inside = inside.groupBy("ring").agg(F.sum("referral_count").alias("ring_referrals"))
    sizes = members.groupBy(F.col("component").alias("ring")).agg(F.count(F.lit(1)).alias("ring_size"))
    rings = sizes.where(F.col("ring_size") >= min_size).join(inside, "ring")
    return members.join(rings, F.col("component") == F.col("ring")).select(
        F.col("node").alias("provider_npi"), "ring", "ring_size", "ring_referrals"
    )


# ---- cores


def core_numbers(edges: DataFrame, source: str, target: str) -> DataFrame:
    """(node, degree, core): the largest k so that the node is in a group of nodes with k neighbours each in the group.

    Each node's estimate starts at its degree and falls to the largest h for which h of its
    neighbours are estimated at h or more, until no estimate falls; it is the core number then.
    A hub's neighbours are counted by their estimates before they are shuffled to it, and an
    estimate above the hub's own counts as its own, so a hub has few rows whatever its degree.
    Every round is a written table.
    """
    pairs = edges.select(F.col(source).alias("a"), F.col(target).alias("b")).where("a is not null and b is not null and a <> b")
    both = pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct()
    both, _ = _kept(both, "core_edges")
    core, falling = _kept(both.groupBy(F.col("a").alias("node")).agg(F.count(F.lit(1)).alias("degree")).select("*", F.col("degree").alias("core")), "cores")
    while falling:
        told = both.join(core.select(F.col("node").alias("b"), F.col("core").alias("told")), "b")
        told = told.join(core.select(F.col("node").alias("a"), F.col("core").alias("own")), "a")
        counts = told.groupBy("a", F.least("told", "own").alias("height")).agg(F.count(F.lit(1)).alias("n"))
        above = Window.partitionBy("a").orderBy(F.desc("height"))
        reach = counts.withColumn("at_least", F.sum("n").over(above))
        heights = reach.groupBy(F.col("a").alias("node")).agg(F.max(F.least("height", "at_least")).alias("now"))
        fell = F.col("now") < F.col("core")
        core, seen = materialise_with(
            core.join(heights, "node").select("node", "degree", F.col("now").alias("core"), fell.alias("fell")),
            "cores", fell=F.coalesce(F.sum(F.col("fell").cast("long")), F.lit(0)),
        )
        core, falling = core.drop("fell"), seen["fell"]
    return core


def provider_cores(
    tables: Tables, start: date | str, end: date | str, *, days: int = 7, min_shared: int = 3, min_core: int = 2
) -> DataFrame:
    """How densely providers are linked through shared patients, and the dense groups.

    (provider_npi, partners, core, dense_group): ``core`` is the core number over
    ``shared_patient_edges``; ``dense_group`` names the connected group of providers with a
    core of at least ``min_core`` after its smallest, and is null outside. Two dense groups
    that one link joins through a provider of small core stay apart, unlike in
    ``provider_clusters``.
    """
    edges = shared_patient_edges(tables, start, end, days=days, min_shared=min_shared)
    edges = materialise(edges.select("provider_npi", "other_provider"), "core_pairs")
    cores = materialise(core_numbers(edges, "provider_npi", "other_provider"), "core_numbers")
    dense = cores.where(F.col("core") >= min_core).select("node")
    inner = edges.join(dense.withColumnRenamed("node", "provider_npi"), "provider_npi", "left_semi")
    inner = inner.join(dense.withColumnRenamed("node", "other_provider"), "other_provider", "left_semi")
    groups = connected_components(inner, "provider_npi", "other_provider").withColumnRenamed("component", "dense_group")
    return cores.join(groups, "node", "left").select(
        F.col("node").alias("provider_npi"), F.col("degree").alias("partners"), "core", "dense_group"
    )


# ---- likely equal texts


def normal_text(text: Column) -> Column:
    """Lower case, with one space for whatever is neither letter nor digit."""
    return F.trim(F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}]+", " "))


def grams(text: Column, q: int) -> Column:
    """The distinct runs of ``q`` characters of a text, with ``q - 1`` marks at both ends; none of an empty text."""
    edge = "\x02" * (q - 1), "\x03" * (q - 1)
    padded = F.concat(F.lit(edge[0]), text, F.lit(edge[1]))
    starts = F.sequence(F.lit(1), F.length(text) + q - 1)
    cut = F.transform(starts, lambda at: F.substr(padded, at, F.lit(q)))
    return F.when(F.length(text) > 0, F.array_distinct(cut)).otherwise(F.array().cast("array<string>"))


#: Columns of a set's bitmap, 64 bits each.
_BITS = ("bits_0", "bits_1", "bits_2", "bits_3")


def _bitmap(gram: str, own: WindowSpec) -> dict[str, Column]:
    """The bitmap of a text's grams: a gram's hash says which bit of which column it sets."""
    number = F.xxhash64(gram)
    bit = F.expr(f"shiftleft(1L, cast(xxhash64({gram}) & 63 as int))")
    word = F.pmod(F.shiftrightunsigned(number, 6), F.lit(len(_BITS)))
    return {name: F.bit_or(F.when(word == n, bit).otherwise(F.lit(0).cast("long"))).over(own) for n, name in enumerate(_BITS)}


def _candidates(named: DataFrame, threshold: float) -> DataFrame:
    """(text_a, text_b) of the sets (text, grams) that may be similar enough, see ``similar_texts``."""
    each = named.select("text", F.size("grams").alias("size"), F.explode("grams").alias("gram"))
    frequency = each.groupBy("gram").agg(F.count(F.lit(1)).alias("texts"))
    own = Window.partitionBy("text")
    rarest = own.orderBy("texts", "gram")  # a text's own grams
    share = F.lit(threshold)
    kept = F.col("size") - F.ceil(share * F.col("size") - 1e-9) + 1
    few = F.col("size") - F.ceil(2 * share / (1 + share) * F.col("size") - 1e-9) + 1
    first = each.join(frequency, "gram").withColumns({"place": F.row_number().over(rarest), **_bitmap("gram", own)}).where(F.col("place") <= kept)
    first = materialise(first.select("gram", "text", "size", "place", *_BITS, (F.col("place") <= few).alias("few")), "first_grams")
    other = first.where("few").select("gram", *[F.col(c).alias(f"{c}_b") for c in ("text", "size", "place", *_BITS)])
    # the larger set, of equal ones that of the smaller text, looks for the smaller
    larger = (F.col("size") > F.col("size_b")) | ((F.col("size") == F.col("size_b")) & (F.col("text") < F.col("text_b")))
    # with the grams behind these in common the overlap must still reach the threshold
    needed = share / (1 + share) * (F.col("size") + F.col("size_b")) - 1e-9
    rest = F.least(F.col("size") - F.col("place"), F.col("size_b") - F.col("place_b")) + 1
    apart = reduce(add, [F.bit_count(F.col(c).bitwiseXOR(F.col(f"{c}_b"))) for c in _BITS])
    return (
        first.join(other, "gram")
        .where(larger & (F.col("size_b") >= share * F.col("size") - 1e-9) & (rest >= needed))
        .where(apart <= F.col("size") + F.col("size_b") - 2 * needed)
        .select(F.least("text", "text_b").alias("text_a"), F.greatest("text", "text_b").alias("text_b"))
        .distinct()
    )


def similar_texts(texts: DataFrame, threshold: float, q: int = 3) -> DataFrame:
    """(text_a, text_b, similarity) of all distinct texts (column ``text``) whose gram sets overlap enough.

    Similarity is the size of the intersection over that of the union. Grams are put in order,
    the rarest first. Of two sets with enough in common the rarest common gram is among the
    first ``n - ceil(threshold * n) + 1`` of the larger and the first
    ``n - ceil(2 * threshold / (1 + threshold) * n) + 1`` of the smaller, so only these are
    joined, together with the sizes and the places that still allow the threshold. A gram that
    very many texts have stands behind rarer ones and is seldom among the few of the smaller.
    Each set has a bitmap, a bit for each gram's hash: sets differ in as many grams as their
    bitmaps in bits, at least, so most pairs go while they are joined. What is left is verified
    on the whole sets.
    """
    if not 0 < threshold <= 1:
        raise ValueError("the threshold is above 0 and at most 1")
    named = texts.select("text").where("text is not null").distinct().withColumn("grams", grams(F.col("text"), q))
    named = materialise(named.where(F.size("grams") > 0), "gram_sets")
    pairs = _candidates(named, threshold)
    sets = named.select("text", "grams")
    verified = (
        pairs.join(sets.select(F.col("text").alias("text_a"), F.col("grams").alias("grams_a")), "text_a")
        .join(sets.select(F.col("text").alias("text_b"), F.col("grams").alias("grams_b")), "text_b")
        .withColumn("common", F.size(F.array_intersect("grams_a", "grams_b")))
        .withColumn("similarity", F.col("common") / (F.size("grams_a") + F.size("grams_b") - F.col("common")))
    )
    return verified.where(F.col("similarity") >= threshold - 1e-12).select("text_a", "text_b", "similarity")


def similar_addresses(tables: Tables, threshold: float = 0.6, q: int = 3) -> DataFrame:
    """Addresses that are written differently and are likely the same, with how many providers use each.

    (address_a, address_b, similarity, providers_a, providers_b): addresses in lower case,
    without punctuation; equal ones are ``shared_identity``'s. Addresses are compared once,
    however many providers have them.
    """
    place = F.concat_ws(" ", "practice_city", "practice_state", "practice_zip")
    complete = F.col("practice_state").isNotNull() & F.col("practice_city").isNotNull() & F.col("practice_zip").isNotNull()
    used = tables["providers"].where(complete).groupBy(normal_text(place).alias("text")).agg(F.count(F.lit(1)).alias("providers"))
    used = materialise(used, "addresses")
    pairs = similar_texts(used, threshold, q)
    a = used.select(F.col("text").alias("text_a"), F.col("providers").alias("providers_a"))
    b = used.select(F.col("text").alias("text_b"), F.col("providers").alias("providers_b"))
    return pairs.join(a, "text_a").join(b, "text_b").select(
        F.col("text_a").alias("address_a"), F.col("text_b").alias("address_b"), "similarity", "providers_a", "providers_b"
    )


# ---- risk through the network


def propagated(
    values: DataFrame, edges: DataFrame, *, damping: float = 0.5, tolerance: float = 1e-9
) -> tuple[DataFrame, float]:
    """Values (node, value) with what their neighbours add, and the residual that is left.

    ``edges`` (a, b, weight) say how much a listens to b. The result solves
    ``spread = (1 - damping) * value + damping * mean of the neighbours' spread``, the mean
    weighted by the edges; nodes without edges keep their value, nodes without a value have 0.
    Rounds go on until no node changes by more than ``tolerance``, the residual; the distance
    to the solution is then at most damping / (1 - damping) times that. Each round is a written
    table. A hub's neighbours are summed before they are shuffled to it.
    """
    if not 0 <= damping < 1:
        raise ValueError("damping is at least 0 and below 1")
    links = edges.where("a is not null and b is not null and a <> b and weight > 0").groupBy("a", "b").agg(F.sum(F.col("weight").cast("double")).alias("weight"))
    links = materialise(links, "risk_edges")
    total = links.groupBy("a").agg(F.sum("weight").alias("total"))
    links = materialise(links.join(total, "a").select("a", "b", (F.col("weight") / F.col("total")).alias("share")), "risk_shares")
    named = values.where("node is not null").groupBy("node").agg(F.max(F.col("value").cast("double")).alias("own"))
    nodes = named.select("node").unionByName(links.select(F.explode(F.array("a", "b")).alias("node"))).distinct()
    start = nodes.join(named, "node", "left").select("node", F.coalesce("own", F.lit(0.0)).alias("own"))
    current = materialise(start.withColumn("spread", F.col("own")), "risk")
    while True:
        told = links.join(current.select(F.col("node").alias("b"), "spread"), "b")
        heard = told.groupBy(F.col("a").alias("node")).agg(F.sum(F.col("share") * F.col("spread")).alias("heard"))
        own = (1 - damping) * F.col("own") + damping * F.col("heard")
        after = current.join(heard, "node", "left").select(
            "node", "own", F.when(F.col("heard").isNull(), F.col("own")).otherwise(own).alias("spread"), F.col("spread").alias("last")
        )
        change = F.coalesce(F.max(F.abs(F.col("spread") - F.col("last"))), F.lit(0.0))
        current, seen = materialise_with(after, "risk", change=change)
        current = current.drop("last")
        if seen["change"] <= tolerance:
            return current.select("node", "own", "spread"), seen["change"]


def network_risk(
    tables: Tables, risk: DataFrame, start: date | str, end: date | str, *, damping: float = 0.5, tolerance: float = 1e-9, min_shared: int = 3
) -> DataFrame:
    """The risk of providers together with that of the providers around them.

    (provider_npi, own_risk, network_risk): ``risk`` has provider_npi and
    composite_risk_score; neighbours are partners in referrals, either way, weighted by their
    number, and in shared patients, weighted by theirs.
    """
    # both kinds of edges read the claims of the period and of the days around it, written once
    near = claims_in(tables, add_days(start, -7), add_days(end, 7))
    near = near.select("provider_npi", "referring_npi", "member_id", "service_date", "allowed_amount")
    tables = {**tables, "claims": materialise(near, "network_claims")}
    referred = referral_edges(tables, start, end).select("referring_npi", "rendering_npi", "referral_count")
    referred = materialise(referred, "referrals")
    shared = shared_patient_edges(tables, start, end, days=7, min_shared=min_shared)
    edges = (
        referred.select(F.col("referring_npi").alias("a"), F.col("rendering_npi").alias("b"), F.col("referral_count").alias("weight"))
        .unionByName(referred.select(F.col("rendering_npi").alias("a"), F.col("referring_npi").alias("b"), F.col("referral_count").alias("weight")))
        .unionByName(shared.select(F.col("provider_npi").alias("a"), F.col("other_provider").alias("b"), F.col("shared_patients").alias("weight")))
    )
    own = risk.select(F.col("provider_npi").alias("node"), F.col("composite_risk_score").alias("value"))
    found, _ = propagated(own, edges, damping=damping, tolerance=tolerance)
    return found.select(F.col("node").alias("provider_npi"), F.col("own").alias("own_risk"), F.col("spread").alias("network_risk"))
