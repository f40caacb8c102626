"""Relationships between providers: referrals, shared patients, clusters."""

from __future__ import annotations

from datetime import date
from itertools import count

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from claimspark.functions.numbers import rounded
from claimspark.functions.periods import (
    Providers,
    Tables,
    add_days,
    between_dates,
    claims_in,
    keep_providers,
)
from claimspark.functions.scratch import materialise, materialise_with

# Least days per join bucket; a wider band has wider buckets, so that a claim meets
# the claims of its own bucket and of one neighbour at most.
BUCKET_DAYS = 30


def referral_edges(tables: Tables, start: date | str, end: date | str) -> DataFrame:
    """All (referring, rendering) pairs with count, allowed sum and distinct patients."""
    return (
        claims_in(tables, start, end)
        .where(F.col("referring_npi").isNotNull())
        .groupBy("referring_npi", F.col("provider_npi").alias("rendering_npi"))
        .agg(
            F.count("*").alias("referral_count"),
            F.sum("allowed_amount").alias("total_allowed"),
            F.count_distinct("member_id").alias("unique_patients"),
        )
    )


def referral_network(
    tables: Tables,
    start: date | str,
    end: date | str,
    providers: Providers = None,
    *,
    top: int | None = None,
) -> DataFrame:
    """The referral edges of each provider, as referrer or as renderer; ``top`` keeps the strongest.

    An edge is listed once for each end (once for a self-referral) under
    ``provider_npi``.
    """
    edges = referral_edges(tables, start, end)
    ends = F.array_distinct(F.array("referring_npi", "rendering_npi"))
    touching = edges.withColumn("provider_npi", F.explode(ends)).where(F.col("provider_npi").isNotNull())
    touching = keep_providers(touching, providers)
    if top is not None:
        order = Window.partitionBy("provider_npi").orderBy(
            F.desc("referral_count"), "referring_npi", "rendering_npi"
        )
        touching = touching.withColumn("_rank", F.row_number().over(order)).where(F.col("_rank") <= top)
    return touching.select(
        "provider_npi", "referring_npi", "rendering_npi", "referral_count", "total_allowed", "unique_patients"
    )


def _bucket(column: str, width: int, shift: int = 0):
    return F.floor((F.unix_date(column) + shift) / width)


def _pairs_in_band(left: DataFrame, right: DataFrame, keys: list[str], days: int) -> DataFrame:
    """Join ``left`` (day, claims) and ``right`` (other_day, other_claims) on ``keys``
    where the days differ by at most ``days``, with the product of the counts.

    The time bucket is part of the key, so one busy member is spread over the
    buckets of the period and only days near each other are compared.
    """
    width = max(BUCKET_DAYS, 2 * days + 1)
    reach = F.sequence(_bucket("day", width, -days), _bucket("day", width, days))
    return (
        left.withColumn("_bucket", F.explode(reach))
        .join(right.withColumn("_bucket", _bucket("other_day", width)), [*keys, "_bucket"])
        .where(F.abs(F.date_diff("day", "other_day")) <= days)
        .withColumn("pairs", F.col("claims") * F.col("other_claims"))
    )


def shared_patient_edges(
    tables: Tables,
    start: date | str,
    end: date | str,
    providers: Providers = None,
    *,
    days: int = 7,
    min_shared: int = 3,
) -> DataFrame:
    """Provider pairs with at least ``min_shared`` members seen by both within ``days`` days.

    (provider_npi, other_provider, shared_patients, combined_claims); the last
    counts pairs of claims. The first provider's claims are those of the period,
    the other's may lie ``days`` outside it.

    A member seen by very many providers must not be expanded into all pairs of
    them. Order all members by how many providers see them, and set aside the first
    ``min_shared - 1`` of each provider. If two providers share ``min_shared``
    members, the last of these in the order has at least ``min_shared - 1`` before
    it in both providers' lists, so neither has set it aside. Candidate pairs are
    therefore formed on the other members alone, and what the members set aside add
    is looked up for the candidates. Nothing is capped or sampled.
    """
    wide = claims_in(tables, add_days(start, -days), add_days(end, days)).dropna(
        subset=["member_id", "provider_npi"]
    )
    seen = wide.groupBy("provider_npi", "member_id", F.col("service_date").alias("day")).agg(
        F.count("*").alias("claims")
    )
    panel = seen.select("provider_npi", "member_id").distinct()
    spread = panel.groupBy("member_id").agg(F.count("*").alias("_spread"))
    widest = Window.partitionBy("provider_npi").orderBy(F.desc("_spread"), "member_id")
    aside = (
        panel.join(spread, "member_id")
        .withColumn("_rank", F.row_number().over(widest))
        .where(F.col("_rank") <= min_shared - 1)
        .select("provider_npi", "member_id", F.lit(True).alias("aside"))
    )
    visits = materialise(
        seen.join(aside, ["provider_npi", "member_id"], "left").withColumn(
            "aside", F.coalesce("aside", F.lit(False))
        ),
        "shared-patient-visits",
    )
    mine = keep_providers(visits.where(between_dates(F.col("day"), start, end)), providers)
    theirs = visits.select(
        F.col("provider_npi").alias("other_provider"), "member_id",
        F.col("day").alias("other_day"), F.col("claims").alias("other_claims"),
        F.col("aside").alias("other_aside"),
    )
    pair = ["provider_npi", "other_provider"]
    candidates = materialise(
        _pairs_in_band(mine.where("not aside"), theirs.where("not other_aside"), ["member_id"], days)
        .where("provider_npi <> other_provider")
        .groupBy(*pair, "member_id")
        .agg(F.sum("pairs").alias("pairs"))
        .groupBy(*pair)
        .agg(F.count("*").alias("shared"), F.sum("pairs").alias("pairs")),
        "shared-patient-candidates",
    )
    known = candidates.select(*pair)
    # Each provider set few members aside. Whether the other saw them is looked up on
    # (provider, member) first; only then are days joined.
    my_members = mine.select("provider_npi", "member_id", "aside").distinct()
    their_members = theirs.select("other_provider", "member_id", "other_aside").distinct()
    # Members set aside by the first provider, whatever they are to the other.
    both_mine = known.join(my_members.where("aside").drop("aside"), "provider_npi").join(
        their_members.drop("other_aside"), ["other_provider", "member_id"]
    )
    through_mine = _pairs_in_band(
        both_mine.join(mine.where("aside"), ["provider_npi", "member_id"]), theirs, ["other_provider", "member_id"], days
    )
    # Members set aside by the other provider only.
    both_theirs = known.join(their_members.where("other_aside").drop("other_aside"), "other_provider").join(
        my_members.where("not aside").drop("aside"), ["provider_npi", "member_id"]
    )
    through_theirs = _pairs_in_band(
        mine.where("not aside"),
        both_theirs.join(theirs.where("other_aside"), ["other_provider", "member_id"]),
        ["provider_npi", "member_id"],
        days,
    )
    added = (
        through_mine.select(*pair, "member_id", "pairs")
        .unionByName(through_theirs.select(*pair, "member_id", "pairs"))
        .groupBy(*pair, "member_id")
        .agg(F.sum("pairs").alias("pairs"))
        .groupBy(*pair)
        .agg(F.count("*").alias("shared"), F.sum("pairs").alias("pairs"))
    )
    return (
        candidates.unionByName(added)
        .groupBy(*pair)
        .agg(F.sum("shared").alias("shared_patients"), F.sum("pairs").alias("combined_claims"))
        .where(F.col("shared_patients") >= min_shared)
    )


def shared_patients(
    tables: Tables,
    start: date | str,
    end: date | str,
    providers: Providers = None,
    *,
    days: int = 7,
    min_shared: int = 3,
    top: int | None = None,
) -> DataFrame:
    """Each provider's partners with their shared patients; ``top`` keeps those with most."""
    edges = shared_patient_edges(
        tables, start, end, providers, days=days, min_shared=min_shared
    )
    if top is None:
        return edges
    order = Window.partitionBy("provider_npi").orderBy(F.desc("shared_patients"), "other_provider")
    return edges.withColumn("_rank", F.row_number().over(order)).where(F.col("_rank") <= top).drop("_rank")


def connected_components(edges: DataFrame, source: str, target: str) -> DataFrame:
    """(node, component): the smallest node name in each node's connected component.

    Alternates two steps until nothing changes: every node links its larger
    neighbours to its smallest one, then its smaller neighbours (and itself) to
    the smallest. The edge list never grows, and the number of rounds is
    logarithmic in the size of a component, so long chains converge too. Each
    round is written to shared storage, which keeps the plan short.
    """
    current = (
        edges.where(F.col(source).isNotNull() & F.col(target).isNotNull() & (F.col(source) != F.col(target)))
        .select(F.greatest(source, target).alias("u"), F.least(source, target).alias("v"))
        .distinct()
    )
    # Row count and an order-free checksum show whether a round changed anything.
    marks = {"rows": F.count("*"), "checksum": F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))}
    current, mark = materialise_with(current, "components-0", **marks)
    previous = None
    for step in count(1):
        if mark == previous:
            break
        previous = mark
        current, mark = materialise_with(_small_star(_large_star(current)), f"components-{step}", **marks)
    return (
        current.select(F.col("u").alias("node"), F.col("v").alias("component"))
        .unionByName(current.select(F.col("v").alias("node"), F.col("v").alias("component")))
        .distinct()
    )


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    smallest = both.groupBy("u").agg(F.min("v").alias("_min")).withColumn("_min", F.least("u", "_min"))
    return (
        both.where(F.col("v") > F.col("u"))
        .join(smallest, "u")
        .select(F.col("v").alias("u"), F.col("_min").alias("v"))
        .distinct()
    )


def _small_star(edges: DataFrame) -> DataFrame:
    smallest = edges.groupBy("u").agg(F.min("v").alias("_min"))
    links = edges.join(smallest, "u").select(
        F.explode(
            F.array(F.struct(F.col("v").alias("u"), F.col("_min").alias("v")),
                    F.struct(F.col("u").alias("u"), F.col("_min").alias("v")))
        ).alias("link")
    )
    return links.select("link.u", "link.v").where("u <> v").distinct()


def provider_clusters(
    tables: Tables,
    start: date | str,
    end: date | str,
    *,
    days: int = 7,
    min_shared: int = 3,
) -> DataFrame:
    """Groups of providers connected through shared patients (possible rings).

    (provider_npi, cluster, cluster_size); the cluster is named after its smallest
    provider. All pairs count here, not only each provider's top partners.
    """
    edges = shared_patient_edges(tables, start, end, days=days, min_shared=min_shared)
    members = connected_components(edges, "provider_npi", "other_provider")
    sizes = members.groupBy("component").agg(F.count("*").alias("cluster_size"))
    return members.join(sizes, "component").select(
        F.col("node").alias("provider_npi"), F.col("component").alias("cluster"), "cluster_size"
    )


def referral_concentration(
    tables: Tables,
    start: date | str,
    end: date | str,
    providers: Providers = None,
    *,
    exact: bool = False,
) -> DataFrame:
    """Each provider's top referrer and that referrer's share of its referrals.

    The share is rounded for display unless ``exact`` is set.
    """
    edges = referral_edges(tables, start, end).where(F.col("rendering_npi").isNotNull())
    # The largest count wins, and the smaller name on a tie.
    ranked = F.min_by("referring_npi", F.struct(-F.col("referral_count"), F.col("referring_npi")))
    share = F.col("top_referrals") / F.col("total_referrals")
    return (
        keep_providers(edges, providers, "rendering_npi")
        .groupBy(F.col("rendering_npi").alias("provider_npi"))
        .agg(
            ranked.alias("top_referrer"),
            F.max("referral_count").alias("top_referrals"),
            F.sum("referral_count").alias("total_referrals"),
            F.count("*").alias("referrers"),
        )
        .withColumn("top_share", share if exact else rounded(share, 4))
    )


def referral_loops(tables: Tables, start: date | str, end: date | str) -> DataFrame:
    """Providers that refer to themselves, and pairs that refer to each other.

    (kind, provider_a, provider_b, forward, backward): ``forward`` counts a to b,
    ``backward`` b to a (0 for a self-referral). One aggregate over the edges finds both kinds.
    """
    edges = referral_edges(tables, start, end).where(F.col("rendering_npi").isNotNull())
    a, b = F.least("referring_npi", "rendering_npi"), F.greatest("referring_npi", "rendering_npi")
    ahead = F.col("referring_npi") <= F.col("rendering_npi")
    return (
        edges.groupBy(a.alias("provider_a"), b.alias("provider_b"))
        .agg(
            F.sum(F.when(ahead, F.col("referral_count"))).alias("forward"),
            F.sum(F.when(~ahead, F.col("referral_count"))).alias("backward"),
        )
        .where("provider_a = provider_b or (forward is not null and backward is not null)")
        .select(
            F.when(F.col("provider_a") == F.col("provider_b"), "self").otherwise("mutual").alias("kind"),
            "provider_a", "provider_b", "forward", F.coalesce("backward", F.lit(0)).alias("backward"),
        )
    )


def _identities(tables: Tables) -> DataFrame:
    place = ["practice_state", "practice_city", "practice_zip"]
    identity = F.array(
        F.struct(F.lit("tax_id").alias("kind"), F.col("tax_id").alias("value")),
        # Concatenation is NULL when a part is, so an incomplete address is no address.
        F.struct(
            F.lit("address").alias("kind"),
            F.concat(place[0], F.lit("|"), place[1], F.lit("|"), place[2]).alias("value"),
        ),
    )
    return (
        tables["providers"].select("npi", F.explode(identity).alias("i"))
        .select("i.kind", F.col("i.value").alias("identity"), F.col("npi").alias("provider_npi"))
        .where("identity is not null")
    )


def shared_identity(tables: Tables) -> DataFrame:
    """Tax ids and addresses used by more than one provider, with how many use them."""
    return (
        _identities(tables)
        .groupBy("kind", "identity")
        .agg(
            F.count("*").alias("provider_count"),
            F.min("provider_npi").alias("first_npi"),
            F.max("provider_npi").alias("last_npi"),
        )
        .where("provider_count > 1")
    )


def shared_identity_members(tables: Tables) -> DataFrame:
    """One row per provider behind a shared tax id or address.

    Rows, not a list per identity: a placeholder tax id may be on a large share of
    all providers.
    """
    shared = shared_identity(tables).select("kind", "identity", "provider_count")
    return _identities(tables).join(shared, ["kind", "identity"])
