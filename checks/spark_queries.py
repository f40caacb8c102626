"""The registered queries: every operator over the whole test tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from checks.oracle import PARTS, dbl, month, rnd, with_needed
from checks.testdata import END, START, VISIT_CODES, claims_tables, table
from claimspark.functions.numbers import decimals_to_double
from claimspark.functions.periods import with_claims
from claimspark.functions.privacy import mask_pii, mask_text
from claimspark.functions.scratch import materialise, scratch_path
from claimspark.operators import claims as C
from claimspark.operators import eligibility as E
from claimspark.operators import graph as G
from claimspark.operators import member as M
from claimspark.operators import network as N
from claimspark.operators import provider as P
from claimspark.operators import signals as S
from claimspark.operators import temporal as T
from claimspark.operators.quality import (
    constraint_report,
    evidence_pack,
    null_profile,
    sort_columns,
    top_rows,
    validate_result,
)
from claimspark.plans.findings import findings, hypothesis_status, provider_scores, stored_period
from claimspark.plans.impact import (
    OVERPAYMENT_CONCEPTS,
    composite_risk,
    impact_rank,
    impact_summary,
    overpayment,
    report_rollup,
    top_providers,
)
from claimspark.plans.registry import CONCEPTS, run, sweep_all
from claimspark.sources.layout import (
    read_claims,
    read_eligibility,
    write_claims,
    write_claims_interleaved,
    write_eligibility,
)
from claimspark.sources.load import (
    keep_first,
    load_rejects,
    load_tables,
    new_rows,
    null_tokens,
    table_counts,
)
from claimspark.sources.schemas import SCHEMAS
from claimspark.streaming.ingest import append_new, create_target, ingest, target_rows
from claimspark.streaming.membership import BUCKET, key_bucket, parts_that_may_hold
from claimspark.streaming.rollup import add_claims, create_rollup, retract, with_rollup

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def register(name: str, query: Query, oracle: str | None = None) -> None:
    """Add a query; its decimals are compared as doubles."""
    QUERIES[name] = lambda spark, sf_dir: decimals_to_double(query(spark, sf_dir))
    if oracle is not None:
        ORACLES[name] = oracle


def over_period(operator: Callable[..., DataFrame], **options) -> Query:
    """A sweep of ``operator`` over all providers for the test period."""
    return lambda spark, sf_dir: operator(claims_tables(spark, sf_dir), START, END, **options)


# --- Claims ---------------------------------------------------------------------

register(
    "high_cost_claims",
    over_period(C.high_cost_claims),
    with_needed(f"""SELECT claim_id, provider_npi, member_id, procedure_code,
        {dbl('allowed_amount')} AS allowed_amount, p95, cost_ratio FROM q_high_cost"""),
)
register("high_cost_claims_brackets", over_period(C.high_cost_claims, brackets=True), ORACLES["high_cost_claims"])
register(
    "upcoding_pattern",
    over_period(C.upcoding_pattern, codes=VISIT_CODES),
    with_needed("SELECT * FROM q_upcoding"),
)
register(
    "duplicate_claims",
    over_period(C.duplicate_claims),
    with_needed(f"""SELECT provider_npi, member_id, procedure_code, service_date, claim_count,
        {dbl('total_allowed')} AS total_allowed FROM q_duplicates"""),
)


def duplicate_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events").select(
        "user_id", "event_type", F.col("ts").cast("date").alias("day"),
        F.col("value").cast("decimal(12,2)").alias("value"),
    )
    return C.duplicates(events, ["user_id", "event_type", "day"], "value")


register(
    "duplicate_events",
    duplicate_events,
    """SELECT user_id, event_type, CAST(ts AS DATE) AS day, count(*) AS claim_count,
              CAST(sum(CAST(value AS DECIMAL(12,2))) AS DOUBLE) AS total_allowed
       FROM events GROUP BY 1, 2, 3 HAVING count(*) > 1""",
)
register(
    "claim_volume_by_period",
    over_period(C.claim_volume_by_period),
    with_needed(f"""SELECT provider_npi, month, claim_count, {dbl('total_allowed')} AS total_allowed,
        avg_allowed FROM q_volume"""),
)

# --- Provider -------------------------------------------------------------------

register(
    "provider_peer_comparison",
    over_period(P.provider_peer_comparison),
    with_needed(f"""SELECT provider_npi, total_claims, {dbl('total_allowed')} AS total_allowed,
        avg_allowed, unique_patients, z_claims, z_allowed FROM q_peers"""),
)
register(
    "provider_specialty_mismatch",
    over_period(P.provider_specialty_mismatch),
    with_needed(f"""SELECT provider_npi, procedure_code, service_date,
        {dbl('allowed_amount')} AS allowed_amount, provider_specialty, procedure_specialty FROM q_mismatch"""),
)
register(
    "provider_specialty_mismatch_literal",
    over_period(P.provider_specialty_mismatch, literal=True),
    with_needed(f"""SELECT c.provider_npi, c.procedure_code, c.service_date,
        {dbl('c.allowed_amount')} AS allowed_amount, p.specialty AS provider_specialty,
        m.expected_specialty AS procedure_specialty
        FROM period_claims c JOIN providers p ON c.provider_npi = p.npi
        JOIN specialty_procedure_map m ON c.procedure_code = m.procedure_code
        WHERE p.specialty <> m.expected_specialty"""),
)

# --- Member ---------------------------------------------------------------------

for _k in (4, 3):
    register(
        "doctor_shopping" if _k == 4 else f"doctor_shopping_{_k}",
        over_period(M.doctor_shopping, min_providers=_k),
        with_needed(f"""SELECT DISTINCT member_id, diagnosis_code, provider_count_30d
            FROM q_seen30 WHERE provider_count_30d >= {_k}"""),
    )
register(
    "member_utilization_spike",
    over_period(M.member_utilization_spike),
    with_needed("SELECT * EXCLUDE (x_ratio) FROM q_util"),
)
register(
    "member_utilization_spike_across_providers",
    over_period(M.member_utilization_spike, across_providers=True),
    with_needed(
        f"""SELECT member_id, month, monthly_claims, {rnd('usual', 1)} AS avg_6m,
            {rnd('monthly_claims / nullif(usual, 0)', 1)} AS spike_ratio
        FROM (SELECT *, avg(monthly_claims) OVER (PARTITION BY member_id ORDER BY month
                        ROWS BETWEEN 6 PRECEDING AND 1 PRECEDING) AS usual
              FROM (SELECT member_id, month, CAST(sum(monthly_claims) AS BIGINT) AS monthly_claims
                    FROM q_util_months GROUP BY member_id, month))
        WHERE month >= DATE '{START}' AND monthly_claims > 3 * coalesce(usual, 0)"""
    ),
)

# --- Eligibility ----------------------------------------------------------------

register(
    "coverage_gap_claims",
    over_period(E.coverage_gap_claims),
    with_needed(f"""SELECT claim_id, provider_npi, member_id, service_date, procedure_code,
        {dbl('allowed_amount')} AS allowed_amount FROM q_gaps"""),
)
register(
    "retroactive_eligibility",
    over_period(E.retroactive_eligibility),
    with_needed(f"""SELECT provider_npi, member_id, coverage_start, coverage_end, created_date,
        CAST(days_retroactive AS INTEGER) AS days_retroactive, claims_in_period,
        {dbl('total_allowed')} AS total_allowed FROM q_retro"""),
)

# --- Time -----------------------------------------------------------------------

register(
    "billing_spike_detection",
    over_period(T.billing_spike_detection),
    with_needed(f"""SELECT provider_npi, month, claims, {dbl('total_allowed')} AS total_allowed,
        rolling_avg, rolling_std, z_score FROM q_spikes"""),
)
register(
    "weekend_billing",
    over_period(T.weekend_billing),
    with_needed(f"""SELECT provider_npi, CAST(dayofweek(service_date) AS INTEGER) AS dow,
        dayname(service_date) AS day_name, count(*) AS claim_count,
        {dbl('sum(allowed_amount)')} AS total_allowed
        FROM period_claims GROUP BY 1, 2, 3"""),
)

# --- Network --------------------------------------------------------------------

_EDGE = f"""referring_npi, rendering_npi, referral_count, {dbl('total_allowed')} AS total_allowed,
        unique_patients"""
register("referral_edges", over_period(N.referral_edges), with_needed(f"SELECT {_EDGE} FROM q_edges"))
register(
    "referral_network",
    over_period(N.referral_network, top=50),
    with_needed(f"""SELECT provider_npi, {_EDGE} FROM q_ends
        QUALIFY row_number() OVER (PARTITION BY provider_npi
                ORDER BY referral_count DESC, referring_npi, rendering_npi) <= 50"""),
)
for _k in (3, 2):
    register(
        "shared_patients" if _k == 3 else f"shared_patients_{_k}",
        over_period(N.shared_patients, min_shared=_k, top=30),
        with_needed(f"""SELECT * FROM q_pairs WHERE shared_patients >= {_k}
            QUALIFY row_number() OVER (PARTITION BY provider_npi
                    ORDER BY shared_patients DESC, other_provider) <= 30"""),
    )
_PAIRS_20 = {
    "q_pairs_20": """
        SELECT a.provider_npi, b.provider_npi AS other_provider,
               count(DISTINCT a.member_id) AS shared_patients, count(*) AS combined_claims
        FROM period_claims a JOIN claims b ON a.member_id = b.member_id
         AND a.provider_npi <> b.provider_npi AND abs(date_diff('day', a.service_date, b.service_date)) <= 20
        GROUP BY 1, 2 HAVING count(DISTINCT a.member_id) >= 3""",
    "q_links_20": "SELECT provider_npi AS a, other_provider AS b FROM q_pairs_20",
    "q_both_20": "SELECT a, b FROM q_links_20 UNION SELECT b, a FROM q_links_20 UNION SELECT a, a FROM q_links_20",
    "q_reach_20": "SELECT a, b FROM q_both_20 UNION SELECT r.a, l.b FROM q_reach_20 r JOIN q_both_20 l ON r.b = l.a",
}
register(
    "shared_patients_days20",
    over_period(N.shared_patients, days=20),
    with_needed("SELECT * FROM q_pairs_20", _PAIRS_20),
)
register(
    "provider_clusters_days20",
    over_period(N.provider_clusters, days=20),
    with_needed(
        """SELECT provider_npi, cluster, count(*) OVER (PARTITION BY cluster) AS cluster_size
           FROM (SELECT a AS provider_npi, min(b) AS cluster FROM q_reach_20 GROUP BY a)""",
        _PAIRS_20,
        recursive=True,
    ),
)
register("referral_network_all", over_period(N.referral_network), with_needed(f"SELECT provider_npi, {_EDGE} FROM q_ends"))
register(
    "referral_concentration",
    over_period(N.referral_concentration),
    with_needed("SELECT * EXCLUDE (x_share) FROM q_concentration"),
)
register(
    "referral_loops",
    over_period(N.referral_loops),
    with_needed(
        """SELECT 'self' AS kind, referring_npi AS provider_a, rendering_npi AS provider_b,
                  referral_count AS forward, 0 AS backward
           FROM q_edges WHERE referring_npi = rendering_npi
           UNION ALL
           SELECT 'mutual', a.referring_npi, a.rendering_npi, a.referral_count, b.referral_count
           FROM q_edges a JOIN q_edges b ON a.referring_npi = b.rendering_npi AND a.rendering_npi = b.referring_npi
           WHERE a.referring_npi < a.rendering_npi"""
    ),
)
for _least, _name in ((1, "referral_rings"), (4, "referral_rings_4")):
    register(
        _name,
        over_period(G.referral_rings, min_referrals=_least),
        with_needed(
            """SELECT node AS provider_npi, ring, count(*) OVER (PARTITION BY ring) AS ring_size, ring_referrals
               FROM q_ring_members JOIN q_ring_sums USING (ring)""",
            {
                "q_arcs": f"""SELECT referring_npi AS a, rendering_npi AS b, referral_count AS n FROM q_edges
                    WHERE referral_count >= {_least} AND referring_npi <> rendering_npi""",
                "q_ways": "SELECT a, b FROM q_arcs UNION SELECT w.a, e.b FROM q_ways w JOIN q_arcs e ON w.b = e.a",
                "q_ring_members": """SELECT x.a AS node, min(x.b) AS ring FROM q_ways x JOIN q_ways y ON x.a = y.b AND x.b = y.a
                    GROUP BY x.a HAVING count(*) > 1""",
                "q_ring_sums": """SELECT m.ring, CAST(sum(n) AS BIGINT) AS ring_referrals FROM q_arcs
                    JOIN q_ring_members m ON m.node = a JOIN q_ring_members o ON o.node = b AND o.ring = m.ring GROUP BY m.ring""",
            },
            recursive=True,
        ),
    )
register(
    "provider_cores",
    over_period(G.provider_cores, min_shared=2),
    with_needed(
        """SELECT node AS provider_npi, degree AS partners, core, dense_group
           FROM q_last LEFT JOIN (SELECT a AS node, min(b) AS dense_group FROM q_dense_reach GROUP BY a) USING (node)""",
        {
            "q_links": "SELECT provider_npi AS a, other_provider AS b FROM q_pairs WHERE shared_patients >= 2",
            "q_sides": "SELECT a, b FROM q_links UNION SELECT b, a FROM q_links",
            # as many rounds as there can be: each lowers a number that is below 40 here
            "q_rounds": """
                SELECT 0 AS round, a AS node, count(*) AS degree, count(*) AS core FROM q_sides GROUP BY a
                UNION ALL
                SELECT round + 1, node, degree, max(least(h, n)) FROM (
                    SELECT c.round, c.node, c.degree, least(o.core, c.core) AS h,
                           count(*) OVER (PARTITION BY c.node ORDER BY least(o.core, c.core) DESC) AS n
                    FROM q_rounds c JOIN q_sides e ON e.a = c.node JOIN q_rounds o ON o.node = e.b WHERE c.round < 40)
                GROUP BY round, node, degree""",
            "q_last": "SELECT node, degree, core FROM q_rounds WHERE round = 40",
            "q_dense": """SELECT a, b FROM q_sides WHERE a IN (SELECT node FROM q_last WHERE core >= 2)
                AND b IN (SELECT node FROM q_last WHERE core >= 2)""",
            "q_dense_reach": """SELECT a, a AS b FROM q_dense UNION SELECT r.a, d.b FROM q_dense_reach r JOIN q_dense d ON r.b = d.a""",
        },
        recursive=True,
    ),
)


def _gram_sets(text: str, rows: str) -> dict[str, str]:
    """SQL for the distinct runs of three characters of each distinct text."""
    return {
        "q_texts": f"SELECT DISTINCT {text} AS text FROM {rows}",
        "q_sets": """SELECT text, list_distinct(list_transform(range(1, len(text) + 3),
            lambda i: substring(chr(2) || chr(2) || text || chr(3) || chr(3), i, 3))) AS grams FROM q_texts WHERE text <> ''""",
        "q_similar": """SELECT *, common / (len(ga) + len(gb) - common)::DOUBLE AS similarity FROM (
            SELECT a.text AS text_a, b.text AS text_b, a.grams AS ga, b.grams AS gb, len(list_intersect(a.grams, b.grams)) AS common
            FROM q_sets a JOIN q_sets b ON a.text < b.text)""",
    }


_ADDRESS = r"trim(regexp_replace(lower(practice_city || ' ' || practice_state || ' ' || practice_zip), '[^\p{L}\p{N}]+', ' ', 'g'))"
register(
    "similar_addresses",
    lambda spark, sf_dir: G.similar_addresses(claims_tables(spark, sf_dir), 0.25),
    with_needed(
        """SELECT text_a AS address_a, text_b AS address_b, similarity, x.n AS providers_a, y.n AS providers_b
           FROM q_similar JOIN q_used x ON x.text = text_a JOIN q_used y ON y.text = text_b WHERE similarity >= 0.25""",
        {"q_used": f"SELECT {_ADDRESS} AS text, count(*) AS n FROM providers GROUP BY 1", **_gram_sets(_ADDRESS, "providers")},
    ),
)
register(
    "similar_page_addresses",
    lambda spark, sf_dir: G.similar_texts(table(spark, sf_dir, "pages").select(F.lower("url").alias("text")), 0.8),
    with_needed("SELECT text_a, text_b, similarity FROM q_similar WHERE similarity >= 0.8", _gram_sets("lower(url)", "pages")),
)
_IDENTITIES = {
    "q_identities": """
        SELECT 'tax_id' AS kind, tax_id AS identity, npi FROM providers
        UNION ALL SELECT 'address', practice_state || '|' || practice_city || '|' || practice_zip, npi FROM providers"""
}
register(
    "shared_identity",
    lambda spark, sf_dir: N.shared_identity(claims_tables(spark, sf_dir)),
    with_needed(
        """SELECT kind, identity, count(*) AS provider_count, min(npi) AS first_npi, max(npi) AS last_npi
           FROM q_identities GROUP BY kind, identity HAVING count(*) > 1""",
        _IDENTITIES,
    ),
)
register(
    "shared_identity_members",
    lambda spark, sf_dir: N.shared_identity_members(claims_tables(spark, sf_dir)),
    with_needed(
        """SELECT kind, identity, npi AS provider_npi, provider_count
           FROM (SELECT *, count(*) OVER (PARTITION BY kind, identity) AS provider_count FROM q_identities)
           WHERE provider_count > 1""",
        _IDENTITIES,
    ),
)
register(
    "provider_clusters",
    over_period(N.provider_clusters, min_shared=2),
    with_needed(
        """SELECT provider_npi, cluster, count(*) OVER (PARTITION BY cluster) AS cluster_size
           FROM (SELECT a AS provider_npi, min(b) AS cluster FROM q_reach GROUP BY a)""",
        {
            "q_links": "SELECT provider_npi AS a, other_provider AS b FROM q_pairs WHERE shared_patients >= 2",
            "q_both": "SELECT a, b FROM q_links UNION SELECT b, a FROM q_links UNION SELECT a, a FROM q_links",
            "q_reach": "SELECT a, b FROM q_both UNION SELECT r.a, l.b FROM q_reach r JOIN q_both l ON r.b = l.a",
        },
        recursive=True,
    ),
)

# --- Signals --------------------------------------------------------------------

register(
    "outlier_severity",
    over_period(S.outlier_severity),
    with_needed(
        """SELECT provider_npi, z_claims, z_allowed, greatest(z_claims, z_allowed) AS z_max,
                  CASE WHEN x_max > 3 THEN 'critical' ELSE 'high' END AS severity
           FROM q_peers WHERE x_max > 2"""
    ),
)
register(
    "outlier_severity_lower",
    over_period(S.outlier_severity, notable=1.0, critical=1.5),
    with_needed(
        """SELECT provider_npi, z_claims, z_allowed, greatest(z_claims, z_allowed) AS z_max,
                  CASE WHEN x_max > 1.5 THEN 'critical' ELSE 'high' END AS severity
           FROM q_peers WHERE x_max > 1"""
    ),
)
register(
    "weekend_share",
    over_period(S.weekend_share),
    with_needed(f"""SELECT provider_npi, specialty, weekend_claims, total_claims,
        {dbl('weekend_allowed')} AS weekend_allowed, weekend_pct, peer_pct, difference FROM q_weekend_share"""),
)
register(
    "ramp_up",
    over_period(S.ramp_up),
    with_needed(f"""SELECT provider_npi, month, {dbl('total_allowed')} AS total_allowed,
        {dbl('previous_allowed')} AS previous_allowed, ramp_ratio FROM q_ramp"""),
)
register(
    "seasonal_deviation",
    over_period(S.seasonal_deviation),
    with_needed(
        f"""SELECT a.provider_npi, a.month, {dbl('a.total_allowed')} AS total_allowed,
                {dbl('b.total_allowed')} AS last_year_allowed,
                {rnd('CAST(a.total_allowed AS DOUBLE) / nullif(CAST(b.total_allowed AS DOUBLE), 0)', 2)} AS seasonal_ratio
            FROM q_months a JOIN q_months b
              ON a.provider_npi = b.provider_npi AND a.month = b.month + INTERVAL 12 MONTH
            WHERE a.month >= DATE '{START}'"""
    ),
)
register(
    "phantom_billing",
    over_period(S.phantom_billing),
    with_needed(f"""SELECT claim_id, provider_npi, member_id, service_date,
        {dbl('allowed_amount')} AS allowed_amount, reason FROM q_phantom"""),
)
register(
    "signal_pairs",
    over_period(S.signal_pairs),
    with_needed(f"SELECT pair, provider_npi, month, signals, {dbl('amount')} AS amount FROM q_signal_pairs"),
)
register(
    "employer_concentration",
    over_period(S.employer_concentration),
    with_needed(f"""SELECT provider_npi, month, employer_group AS top_employer, employer_claims, total_claims,
        {rnd('employer_claims / total_claims', 4)} AS employer_share FROM q_employers"""),
)

# --- Findings, impact and reports -----------------------------------------------


def stored_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of all concepts, made from the tables and written once for the reports of this query."""
    return materialise(provider_scores(claims_tables(spark, sf_dir), START, END, codes=VISIT_CODES), "scores")


def estimates(spark: SparkSession, sf_dir: str) -> DataFrame:
    tables = claims_tables(spark, sf_dir)
    return overpayment(
        provider_scores(tables, START, END, codes=VISIT_CODES, concepts=OVERPAYMENT_CONCEPTS)
    )


def found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return findings(stored_scores(spark, sf_dir))


def flat_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    metric = lambda name: F.col("metrics")[name].alias(name)
    return found(spark, sf_dir).select(
        "provider_npi", "domain", "concept", "finding_type", "severity", "confidence",
        metric("row_count"), metric("score"), "amount", "recoverable",
    )


def hypotheses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One hypothesis per provider and concept."""
    names = F.explode(F.array(*[F.lit(name) for name in CONCEPTS]))
    return claims_tables(spark, sf_dir)["providers"].select(
        F.col("npi").alias("provider_npi"), names.alias("concept")
    ).withColumn("hypothesis_id", F.concat_ws(":", "provider_npi", "concept"))


def report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report_rollup(stored_scores(spark, sf_dir), START, END)


def flat_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    listed = F.transform("top_findings", lambda x: F.concat_ws(":", x["concept"], x["severity"]))
    return report(spark, sf_dir).withColumn("top_findings", F.array_join(listed, ","))


register("findings", flat_findings, with_needed("SELECT * FROM q_findings"))
register(
    "hypothesis_status",
    lambda spark, sf_dir: hypothesis_status(hypotheses(spark, sf_dir), found(spark, sf_dir)),
    with_needed(
        """SELECT npi || ':' || r.concept AS hypothesis_id, npi AS provider_npi, r.concept,
                  coalesce(confidence, 0) AS confidence,
                  CASE WHEN coalesce(confidence, 0) > 0.6 THEN 'supported'
                       WHEN coalesce(confidence, 0) < 0.3 THEN 'refuted' ELSE 'open' END AS status
           FROM providers CROSS JOIN q_rules r
           LEFT JOIN q_findings f ON f.provider_npi = npi AND f.concept = r.concept"""
    ),
)
register(
    "overpayment",
    estimates,
    with_needed("SELECT * FROM q_overpayment"),
)
register(
    "impact_summary",
    lambda spark, sf_dir: impact_summary(estimates(spark, sf_dir), START, END),
    with_needed("SELECT * FROM q_impact"),
)
register(
    "impact_rank",
    lambda spark, sf_dir: impact_rank(found(spark, sf_dir)),
    with_needed("SELECT * FROM q_ranked"),
)
register(
    "composite_risk",
    lambda spark, sf_dir: composite_risk(found(spark, sf_dir)),
    with_needed("SELECT provider_npi, composite_risk_score, domains, risk_category FROM q_risk"),
)
register("report_rollup", flat_report, with_needed("SELECT * FROM q_report"))
register(
    "top_providers",
    lambda spark, sf_dir: top_providers(report(spark, sf_dir), 100),
    with_needed(
        """SELECT CAST(rank() OVER (ORDER BY composite_risk_score DESC, impact_mid DESC) AS INTEGER) AS follow_up_rank,
                  provider_npi, composite_risk_score, risk_category, total_findings, impact_mid
           FROM (SELECT * FROM q_report ORDER BY composite_risk_score DESC, impact_mid DESC, provider_npi LIMIT 100)"""
    ),
)
register(
    "top_providers_25",
    lambda spark, sf_dir: top_providers(report(spark, sf_dir), 25),
    with_needed(
        """SELECT CAST(rank() OVER (ORDER BY composite_risk_score DESC, impact_mid DESC) AS INTEGER) AS follow_up_rank,
                  provider_npi, composite_risk_score, risk_category, total_findings, impact_mid
           FROM (SELECT * FROM q_report ORDER BY composite_risk_score DESC, impact_mid DESC, provider_npi LIMIT 25)"""
    ),
)

register(
    "network_risk",
    lambda spark, sf_dir: G.network_risk(claims_tables(spark, sf_dir), report(spark, sf_dir), START, END).select(
        "provider_npi", F.round("own_risk", 6).alias("own_risk"), F.round("network_risk", 5).alias("network_risk")
    ),
    with_needed(
        "SELECT node AS provider_npi, round(own, 6) AS own_risk, round(spread, 5) AS network_risk FROM q_waves WHERE round = 40",
        {
            "q_heard": """SELECT referring_npi AS a, rendering_npi AS b, referral_count AS w FROM q_edges
                UNION ALL SELECT rendering_npi, referring_npi, referral_count FROM q_edges
                UNION ALL SELECT provider_npi, other_provider, shared_patients FROM q_pairs WHERE shared_patients >= 3""",
            "q_weights": "SELECT a, b, sum(w)::DOUBLE AS w FROM q_heard WHERE a IS NOT NULL AND b IS NOT NULL AND a <> b GROUP BY a, b",
            "q_shares": "SELECT a, b, w / sum(w) OVER (PARTITION BY a) AS share FROM q_weights",
            "q_nodes": """SELECT node, coalesce(CAST(composite_risk_score AS DOUBLE), 0.0) AS own
                FROM (SELECT provider_npi AS node FROM q_report UNION SELECT a FROM q_shares UNION SELECT b FROM q_shares)
                LEFT JOIN q_report ON provider_npi = node""",
            "q_waves": """
                SELECT 0 AS round, node, own, own AS spread FROM q_nodes
                UNION ALL
                SELECT w.round + 1, w.node, any_value(w.own),
                       CASE WHEN count(share) = 0 THEN any_value(w.own) ELSE 0.5 * any_value(w.own) + 0.5 * sum(share * o.spread) END
                FROM q_waves w LEFT JOIN q_shares s ON s.a = w.node LEFT JOIN q_waves o ON o.node = s.b
                WHERE w.round < 40 GROUP BY w.round, w.node""",
        },
        recursive=True,
    ),
)

# --- Loading and layout ---------------------------------------------------------


def csv_folder(spark: SparkSession, sf_dir: str, *names: str) -> str:
    """Tables written as CSV with every column of their schema, nulls as NULL."""
    root, tables = scratch_path(spark, "csv"), claims_tables(spark, sf_dir)
    for name in names or tables:
        df = tables[name]
        full = df.select(
            *[
                (F.col(f.name) if f.name in df.columns else F.lit(None)).cast(f.dataType).alias(f.name)
                for f in SCHEMAS[name].fields
            ]
        )
        full.write.option("header", True).option("nullValue", "NULL").csv(f"{root}/{name}.csv")
    return root


def loaded_claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    tables = load_tables(spark, csv_folder(spark, sf_dir, "claims"), ["claims"])
    return tables["claims"].select(*claims_tables(spark, sf_dir)["claims"].columns)


_CLAIM = f"""claim_id, member_id, provider_npi, referring_npi, service_date, procedure_code,
        diagnosis_code, service_state, {dbl('allowed_amount')} AS allowed_amount"""
register(
    "load_claims",
    loaded_claims,
    with_needed(f"""SELECT {_CLAIM} FROM claims QUALIFY row_number() OVER (PARTITION BY claim_id
        ORDER BY member_id, provider_npi, referring_npi NULLS FIRST, service_date, procedure_code) = 1"""),
)
register(
    "load_table_counts",
    lambda spark, sf_dir: table_counts(load_tables(spark, csv_folder(spark, sf_dir))),
    with_needed(
        """SELECT 'providers' AS tbl, count(DISTINCT npi) AS rows FROM providers
           UNION ALL SELECT 'members', count(DISTINCT member_id) FROM members
           UNION ALL SELECT 'eligibility', count(DISTINCT eligibility_id) FROM eligibility
           UNION ALL SELECT 'claims', count(DISTINCT claim_id) FROM claims
           UNION ALL SELECT 'specialty_procedure_map', count(*) FROM specialty_procedure_map"""
    ),
)


def rejected_eligibility(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Low-priority orders get an unreadable coverage end; those lines must be set aside."""
    orders = table(spark, sf_dir, "orders")
    day = F.col("o_orderdate").cast("date").cast("string")
    text = orders.select(
        F.col("o_orderkey").cast("string").alias("eligibility_id"),
        F.col("o_custkey").cast("string").alias("member_id"),
        day.alias("coverage_start"),
        F.when(F.col("o_orderpriority") == "5-LOW", "soon").otherwise(day).alias("coverage_end"),
        F.lit("P").alias("plan_code"), F.lit("medical").alias("coverage_type"),
        F.lit("active").alias("status"), day.alias("created_date"),
    )
    path = scratch_path(spark, "rejects")
    text.write.option("header", True).csv(path)
    lines = load_rejects(spark, "eligibility", path)
    return lines.select(F.split_part("line", F.lit(","), F.lit(1)).alias("eligibility_id"))


register(
    "load_rejects",
    rejected_eligibility,
    "SELECT CAST(o_orderkey AS VARCHAR) AS eligibility_id FROM orders WHERE o_orderpriority = '5-LOW'",
)


def tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order status O becomes an empty string and F the token NULL, then both become null."""
    status = F.when(F.col("o_orderstatus") == "O", "").when(F.col("o_orderstatus") == "F", "NULL")
    return null_tokens(
        table(spark, sf_dir, "orders").select(
            "o_orderkey", status.otherwise(F.col("o_orderstatus")).alias("status"), "o_orderpriority"
        )
    )


register(
    "null_tokens",
    tokens,
    """SELECT o_orderkey, CASE WHEN o_orderstatus NOT IN ('O', 'F') THEN o_orderstatus END AS status,
              o_orderpriority FROM orders""",
)


def first_per_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    lineitem = table(spark, sf_dir, "lineitem").withColumn("l_shipdate", F.col("l_shipdate").cast("date"))
    return keep_first(lineitem, ["l_orderkey", "l_linenumber"])


register(
    "pk_dedupe",
    first_per_key,
    """SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, l_quantity, l_extendedprice, l_discount, l_tax,
              l_returnflag, l_linestatus, CAST(l_shipdate AS DATE) AS l_shipdate FROM lineitem
       QUALIFY row_number() OVER (PARTITION BY l_orderkey, l_linenumber
               ORDER BY l_partkey, l_suppkey, l_quantity, l_extendedprice, l_discount, l_tax,
                        l_returnflag, l_linestatus, l_shipdate) = 1""",
)


def unknown_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Members are already loaded; coverage brings the first row of each new one."""
    tables = claims_tables(spark, sf_dir)
    return new_rows(
        tables["eligibility"], tables["members"], ["member_id"], ["coverage_start", "eligibility_id"]
    )


register(
    "incremental_load",
    unknown_members,
    with_needed(
        """SELECT * FROM eligibility WHERE member_id NOT IN (SELECT member_id FROM members)
           QUALIFY row_number() OVER (PARTITION BY member_id ORDER BY coverage_start, eligibility_id) = 1"""
    ),
)


def streamed_eligibility(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Coverage written as CSV and loaded by two runs of the incremental load."""
    source, target = scratch_path(spark, "stream-csv"), scratch_path(spark, "stream-parquet")
    rejects, checkpoint = scratch_path(spark, "stream-rejects"), scratch_path(spark, "stream-checkpoint")
    rows = claims_tables(spark, sf_dir)["eligibility"]
    full = rows.select(
        *[(F.col(f.name) if f.name in rows.columns else F.lit(None)).cast(f.dataType).alias(f.name)
          for f in SCHEMAS["eligibility"].fields]
    )
    for _ in range(2):  # the second time all keys are known
        full.write.mode("append").option("header", True).csv(source)
        ingest(spark, "eligibility", source, target, rejects, checkpoint).awaitTermination()
    return spark.read.schema(SCHEMAS["eligibility"]).parquet(target).select(*rows.columns)


register("incremental_ingest", streamed_eligibility, with_needed("SELECT * FROM eligibility"))


def texts_with_line_breaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole documents as a column of the map's CSV, line breaks and quotes included."""
    path = scratch_path(spark, "csv")
    docs = table(spark, sf_dir, "documents").select(
        F.col("doc_id").cast("string").alias("procedure_code"), F.col("text").alias("expected_specialty"), F.col("source").alias("category")
    )
    kept = {"ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False, "escape": '"', "nullValue": "NULL"}
    docs.write.options(header=True, **kept).csv(f"{path}/specialty_procedure_map.csv")
    found = load_tables(spark, path, ["specialty_procedure_map"], multi_line=True)["specialty_procedure_map"]
    return found.select("procedure_code", "category", F.length("expected_specialty").alias("n_chars"), F.sha2("expected_specialty", 256).alias("sha256"))


register(
    "load_line_breaks",
    texts_with_line_breaks,
    """SELECT CAST(doc_id AS VARCHAR) AS procedure_code, source AS category, CAST(length(text) AS INTEGER) AS n_chars, sha256(text) AS sha256
       FROM (SELECT doc_id, source, nullif(text, '') AS text FROM documents)""",
)


def eligibility_in_two_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Half of the coverage's files have their columns in the opposite order."""
    path, rows = scratch_path(spark, "csv"), claims_tables(spark, sf_dir)["eligibility"]
    half = F.pmod(F.xxhash64("eligibility_id"), F.lit(2)) == 0
    for chosen, columns in ((half, rows.columns), (~half, rows.columns[::-1])):
        rows.where(chosen).select(*columns).write.mode("append").option("header", True).csv(f"{path}/eligibility.csv")
    return load_tables(spark, path, ["eligibility"])["eligibility"].select(*rows.columns)


register("load_two_orders", eligibility_in_two_orders, with_needed("SELECT * FROM eligibility"))


def known_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Coverage loaded by quarters; of the orders with low priority and the customers' numbers, those that are loaded ids.

    The index names the parts that may hold them; only these are read.
    """
    target = scratch_path(spark, "keyed")
    index, keys = f"{target}.index", ["eligibility_id"]
    rows = claims_tables(spark, sf_dir)["eligibility"]
    full = rows.select(
        *[(F.col(f.name) if f.name in rows.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in SCHEMAS["eligibility"].fields]
    )
    create_target(spark, "eligibility", target, index)
    for quarter in range(1, 5):  # four loads
        append_new(spark, "eligibility", full.where(F.quarter("coverage_start") == quarter), target, index, 16)
    low = table(spark, sf_dir, "orders").where("o_orderpriority = '5-LOW'").select(F.col("o_orderkey").cast("string").alias(keys[0]))
    other = table(spark, sf_dir, "customer").select(F.concat(F.lit("X"), "c_custkey").alias(keys[0]))
    asked = low.unionByName(other).withColumn(BUCKET, key_bucket(keys, 16))
    held = target_rows(spark, "eligibility", target, parts_that_may_hold(spark, index, asked, keys))
    return asked.select(*keys).join(held.select(*keys, "coverage_start"), keys)


register(
    "known_keys",
    known_keys,
    with_needed(
        """SELECT eligibility_id, coverage_start FROM eligibility
           WHERE eligibility_id IN (SELECT CAST(o_orderkey AS VARCHAR) FROM orders WHERE o_orderpriority = '5-LOW')"""
    ),
)


def rollup_of(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    """Claims summed in three loads, by their order's priority; those of over 50,000 are rejected afterwards."""
    tables, rollup = claims_tables(spark, sf_dir), scratch_path(spark, "rollup")
    create_rollup(spark, rollup)
    claims = tables["claims"].select("provider_npi", "member_id", "service_date", "diagnosis_code", "allowed_amount")
    claims = materialise(claims, "priced_claims")  # read by four jobs
    loads = [F.col("diagnosis_code") < "2", F.col("diagnosis_code").between("2", "4"), F.col("diagnosis_code") > "4"]
    for number, chosen in enumerate(loads):
        add_claims(claims.where(chosen), rollup, number)
    retract(claims.where("allowed_amount > 50000"), rollup, 1)
    return with_rollup(tables, spark, rollup)


_REJECTED = {"claims": f"SELECT * FROM ({PARTS['claims']}) WHERE allowed_amount <= 50000"}
register(
    "rollup_billing_spikes",
    lambda spark, sf_dir: T.billing_spike_detection(rollup_of(spark, sf_dir), START, END).select(
        "provider_npi", "month", "claims", F.col("total_allowed").cast("double").alias("total_allowed"),
        "rolling_avg", "rolling_std", "z_score",
    ),
    with_needed(f"""SELECT provider_npi, month, claims, {dbl('total_allowed')} AS total_allowed,
        rolling_avg, rolling_std, z_score FROM q_spikes""", _REJECTED),
)
register(
    "rollup_member_spikes",
    lambda spark, sf_dir: M.member_utilization_spike(rollup_of(spark, sf_dir), START, END),
    with_needed("SELECT * EXCLUDE (x_ratio) FROM q_util", _REJECTED),
)


def clustered_claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "clustered")
    write_claims(claims_tables(spark, sf_dir)["claims"], path)
    return read_claims(spark, path, START, END)


def all_clustered_claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "clustered")
    write_claims(claims_tables(spark, sf_dir)["claims"], path)
    return read_claims(spark, path)


register("clustered_claims", clustered_claims, with_needed(f"SELECT {_CLAIM} FROM period_claims"))
register("clustered_claims_all", all_clustered_claims, with_needed(f"SELECT {_CLAIM} FROM claims"))


def interleaved_claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Claims stored in the order of provider and member at once; those of the period read back."""
    path = scratch_path(spark, "interleaved")
    write_claims_interleaved(claims_tables(spark, sf_dir)["claims"], path)
    return read_claims(spark, path, START, END)


register("interleaved_claims", interleaved_claims, with_needed(f"SELECT {_CLAIM} FROM period_claims"))


def clustered_eligibility(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "clustered")
    write_eligibility(claims_tables(spark, sf_dir)["eligibility"], path)
    return read_eligibility(spark, path)


register("clustered_eligibility", clustered_eligibility, with_needed("SELECT * FROM eligibility"))
register(
    "table_counts",
    lambda spark, sf_dir: table_counts(claims_tables(spark, sf_dir)),
    with_needed(
        """SELECT 'providers' AS tbl, count(*) AS rows FROM providers
           UNION ALL SELECT 'members', count(*) FROM members
           UNION ALL SELECT 'eligibility', count(*) FROM eligibility
           UNION ALL SELECT 'claims', count(*) FROM claims
           UNION ALL SELECT 'specialty_procedure_map', count(*) FROM specialty_procedure_map"""
    ),
)

# --- Privacy and quality --------------------------------------------------------

register(
    "mask_pii",
    lambda spark, sf_dir: mask_pii(
        table(spark, sf_dir, "customer").select("c_custkey", F.col("c_name").alias("Full_Name"), "c_mktsegment")
    ),
    """SELECT c_custkey, '***REDACTED***' AS "Full_Name", c_mktsegment FROM customer""",
)


def _masked(text: str) -> str:
    ssn = r"'\b\p{Nd}{3}-\p{Nd}{2}-\p{Nd}{4}\b', '***-**-****', 'g'"
    phone = r"'\b\p{Nd}{3}[-.)]\s*\p{Nd}{3}[-.)]\s*\p{Nd}{4}\b', '***-***-****', 'g'"
    return f"regexp_replace(regexp_replace({text}, {ssn}), {phone})"


register(
    "mask_text",
    lambda spark, sf_dir: table(spark, sf_dir, "documents").select("doc_id", mask_text(F.col("text")).alias("text")),
    f"SELECT doc_id, {_masked('text')} AS text FROM documents",
)
register(
    "mask_text_conversations",
    lambda spark, sf_dir: table(spark, sf_dir, "conversations").select(
        "conv_id", "turn", mask_text(F.col("text")).alias("text")
    ),
    f"SELECT conv_id, turn, {_masked('text')} AS text FROM conversations",
)

_COLUMNS = (
    "claim_id member_id provider_npi referring_npi service_date procedure_code diagnosis_code "
    "service_state allowed_amount"
).split()
register(
    "null_profile",
    lambda spark, sf_dir: null_profile(claims_tables(spark, sf_dir)["claims"]),
    with_needed(
        "\nUNION ALL ".join(
            f"""SELECT '{c}' AS "column", count(*) AS row_count,
                {rnd(f"count(*) FILTER ({c} IS NULL) * 100.0::DOUBLE / count(*)", 2)} AS null_pct,
                count(*) FILTER ({c} IS NULL) * 2 > count(*) AS is_warning,
                CASE WHEN count(*) FILTER ({c} IS NULL) * 2 > count(*)
                     THEN 'Column ''{c}'' is ' || CAST(round_even(count(*) FILTER ({c} IS NULL) * 100.0 / count(*), 0) AS INTEGER)
                          || '% null — data may be incomplete' END AS warning
                FROM claims"""
            for c in _COLUMNS
        )
    ),
)
register(
    "top_rows",
    lambda spark, sf_dir: top_rows(
        claims_tables(spark, sf_dir)["claims"].select("claim_id", "provider_npi", "allowed_amount"),
        sort_columns(("-allowed_amount", "claim_id")),
    ),
    with_needed(f"""SELECT claim_id, provider_npi, {dbl('allowed_amount')} AS allowed_amount
        FROM claims ORDER BY claims.allowed_amount DESC, claim_id LIMIT 5000"""),
)
register(
    "constraint_report",
    lambda spark, sf_dir: constraint_report(claims_tables(spark, sf_dir)),
    with_needed(
        """SELECT 'primary_key' AS "constraint", 'providers' AS "table", 'npi' AS "columns",
                  count(*) - count(DISTINCT npi) AS violations FROM providers
           UNION ALL SELECT 'primary_key', 'members', 'member_id', count(*) - count(DISTINCT member_id) FROM members
           UNION ALL SELECT 'primary_key', 'eligibility', 'eligibility_id',
                  count(*) - count(DISTINCT eligibility_id) FROM eligibility
           UNION ALL SELECT 'primary_key', 'claims', 'claim_id', count(*) - count(DISTINCT claim_id) FROM claims
           UNION ALL SELECT 'primary_key', 'specialty_procedure_map', 'procedure_code,expected_specialty',
                  count(*) - count(DISTINCT (procedure_code, expected_specialty)) FROM specialty_procedure_map
           UNION ALL SELECT 'foreign_key', 'claims', 'member_id', count(*) FROM claims
                  WHERE member_id NOT IN (SELECT member_id FROM members)
           UNION ALL SELECT 'foreign_key', 'claims', 'provider_npi', count(*) FROM claims
                  WHERE provider_npi NOT IN (SELECT npi FROM providers)
           UNION ALL SELECT 'foreign_key', 'eligibility', 'member_id', count(*) FROM eligibility
                  WHERE member_id NOT IN (SELECT member_id FROM members)"""
    ),
)

# Per concept: the subquery with one row per result row, the record's fields, the display order.
_EVIDENCE = {
    "high_cost_claims": ("q_high_cost", "claim_id member_id procedure_code allowed_amount p95 cost_ratio",
                         "cost_ratio DESC NULLS LAST, claim_id"),
    "upcoding_pattern": ("q_upcoding", "procedure_code provider_pct peer_pct delta", "procedure_code"),
    "duplicate_claims": ("q_duplicates", "member_id procedure_code service_date claim_count total_allowed",
                         "claim_count DESC, member_id, procedure_code, service_date"),
    "claim_volume_by_period": ("q_volume", "month claim_count total_allowed avg_allowed", "month"),
    "provider_peer_comparison": (
        "q_peers", "total_claims total_allowed avg_allowed unique_patients z_claims z_allowed", "provider_npi"),
    "provider_specialty_mismatch": (
        "q_mismatch", "procedure_code service_date allowed_amount provider_specialty procedure_specialty",
        "allowed_amount DESC, service_date, procedure_code, procedure_specialty"),
    "doctor_shopping": ("q_shopping", "member_id diagnosis_code provider_count_30d claims total_allowed",
                        "provider_count_30d DESC, member_id, diagnosis_code"),
    "member_utilization_spike": ("q_util", "member_id month monthly_claims avg_6m spike_ratio",
                                 "spike_ratio DESC NULLS LAST, member_id, month"),
    "coverage_gap_claims": ("q_gaps", "claim_id member_id service_date procedure_code allowed_amount",
                            "allowed_amount DESC, claim_id"),
    "retroactive_eligibility": (
        "q_retro", "member_id coverage_start coverage_end created_date days_retroactive claims_in_period total_allowed",
        "days_retroactive DESC, member_id, coverage_start, coverage_end, created_date"),
    "billing_spike_detection": ("q_spikes", "month claims total_allowed rolling_avg rolling_std z_score",
                                "z_score DESC, month"),
    "weekend_billing": ("q_days", "dow day_name claim_count total_allowed", "dow"),
    "referral_network": ("q_ends", "referring_npi rendering_npi referral_count total_allowed unique_patients",
                         "referral_count DESC, referring_npi, rendering_npi"),
    "shared_patients": ("q_partners", "other_provider shared_patients combined_claims",
                        "shared_patients DESC, other_provider"),
}


def evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    whole = claims_tables(spark, sf_dir)
    tables = stored_period(whole, START, END, 24, 7)
    results = sweep_all(
        tables, START, END,
        options={"upcoding_pattern": {"codes": VISIT_CODES}},
        operators={"doctor_shopping": M.doctor_shopping_by_provider},
    )
    orders = {name: sort_columns(concept.order) for name, concept in CONCEPTS.items()}
    sizes = {name: concept.sample for name, concept in CONCEPTS.items()}
    return evidence_pack(results, orders, sample=sizes, asked=tables["providers"].withColumnRenamed("npi", "provider_npi"))


def _evidence_oracle() -> str:
    packs = []
    for name, (source, fields, order) in _EVIDENCE.items():
        size = 30 if name in ("billing_spike_detection", "weekend_billing") else 20
        money = {"total_allowed", "allowed_amount"}
        shown = {f: f"CAST({dbl(f) if f in money else f} AS VARCHAR)" for f in fields.split()}
        record = ", ".join(f"'{f}', {value}" for f, value in shown.items())
        warnings = ", ".join(
            f"""CASE WHEN 2 * count(*) FILTER ({f} IS NULL) > count(*) THEN 'Column ''{f}'' is '
                || CAST(round_even(count(*) FILTER ({f} IS NULL) * 100.0 / count(*), 0) AS INTEGER)
                || '% null — data may be incomplete' END"""
            for f in fields.split()
        )
        packs.append(
            f"""SELECT '{name}' AS concept, npi AS provider_npi, coalesce(n, 0) AS row_count, coalesce(sample, '') AS sample,
                CASE WHEN n IS NULL THEN 'No results returned — concept may not apply to this entity' ELSE warnings END AS warnings
            FROM (SELECT provider_npi, any_value(n) AS n, concat_ws('; ', {warnings}) AS warnings,
                string_agg(CAST(json_object({record}) AS VARCHAR), chr(10) ORDER BY place) FILTER (place <= {size}) AS sample
            FROM (SELECT *, count(*) OVER (PARTITION BY provider_npi) AS n,
                         row_number() OVER (PARTITION BY provider_npi ORDER BY {order}) AS place FROM {source})
            GROUP BY provider_npi) FULL JOIN providers ON npi = provider_npi"""
        )
    extra = {
        "q_days": """SELECT provider_npi, dayofweek(service_date) AS dow, dayname(service_date) AS day_name,
                     count(*) AS claim_count, sum(allowed_amount) AS total_allowed FROM period_claims GROUP BY 1, 2, 3""",
    }
    return with_needed("\nUNION ALL ".join(packs), extra)


def flat_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records with their values as text, because engines write numbers differently."""
    as_text = lambda record: F.to_json(F.from_json(record, "map<string,string>"), {"ignoreNullFields": "false"})
    return evidence(spark, sf_dir).select(
        "concept", "provider_npi", "row_count", F.array_join("warnings", "; ").alias("warnings"),
        F.array_join(F.transform("sample", as_text), "\n").alias("sample"),
    )


register("evidence_pack", flat_evidence, _evidence_oracle())


def warnings_of(df: DataFrame) -> DataFrame:
    return validate_result(df)[1]


register(
    "validate_empty",
    lambda spark, sf_dir: warnings_of(claims_tables(spark, sf_dir)["claims"].where("service_date < date'1900-01-01'")),
    with_needed("""SELECT 'No results returned — concept may not apply to this entity' AS warning
        FROM (SELECT count(*) AS n FROM claims WHERE service_date < DATE '1900-01-01') WHERE n = 0"""),
)
register(
    "validate_mostly_null",
    lambda spark, sf_dir: warnings_of(claims_tables(spark, sf_dir)["claims"]),
    with_needed("""SELECT 'Column ''referring_npi'' is '
               || CAST(round_even(count(*) FILTER (referring_npi IS NULL) * 100.0 / count(*), 0) AS INTEGER)
               || '% null — data may be incomplete' AS warning
        FROM claims HAVING 2 * count(*) FILTER (referring_npi IS NULL) > count(*)"""),
)


# --- Options --------------------------------------------------------------------

register(
    "upcoding_exclude_self",
    over_period(C.upcoding_pattern, codes=VISIT_CODES, exclude_self=True),
    with_needed(f"""SELECT provider_npi, procedure_code, {rnd('pct', 1)} AS provider_pct,
            {rnd('(peer_n - n) * 100.0::DOUBLE / nullif(peer_total - total, 0)', 1)} AS peer_pct,
            {rnd('pct - (peer_n - n) * 100.0::DOUBLE / nullif(peer_total - total, 0)', 1)} AS delta
        FROM (SELECT m.*, sum(m.n) OVER (PARTITION BY m.provider_npi) AS total,
                     (SELECT sum(q.n) FROM q_peer_mix q WHERE q.specialty = p.specialty) AS peer_total
              FROM q_mix m JOIN providers p ON m.provider_npi = p.npi)"""),
)
register(
    "peer_comparison_exclude_self",
    over_period(P.provider_peer_comparison, exclude_self=True),
    with_needed(f"""SELECT t.provider_npi, any_value(t.total_claims) AS total_claims,
            any_value({dbl('t.total_allowed')}) AS total_allowed, any_value(t.avg_allowed) AS avg_allowed,
            any_value(t.unique_patients) AS unique_patients,
            {rnd('(any_value(t.total_claims) - avg(o.total_claims)) / nullif(stddev_samp(o.total_claims), 0)', 2)} AS z_claims,
            {rnd('(any_value(CAST(t.total_allowed AS DOUBLE)) - avg(CAST(o.total_allowed AS DOUBLE))) '
                 '/ nullif(stddev_samp(CAST(o.total_allowed AS DOUBLE)), 0)', 2)} AS z_allowed
        FROM q_totals t JOIN providers p ON t.provider_npi = p.npi
        LEFT JOIN (SELECT * FROM q_totals JOIN providers ON provider_npi = npi) o
          ON o.specialty = p.specialty AND o.practice_state = p.practice_state AND o.provider_npi <> t.provider_npi
        GROUP BY t.provider_npi"""),
)


def first_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order dates that are the first of a month, as holidays."""
    day = F.col("o_orderdate").cast("date")
    return table(spark, sf_dir, "orders").where(F.dayofmonth(day) == 1).select(day.alias("holiday_date")).distinct()


register(
    "weekend_share_holidays",
    lambda spark, sf_dir: S.weekend_share(claims_tables(spark, sf_dir), START, END, holidays=first_days(spark, sf_dir)),
    with_needed(
        f"""SELECT w.provider_npi, w.specialty, weekend_claims, total_claims, {dbl('weekend_allowed')} AS weekend_allowed,
                {rnd('weekend_claims * 100.0::DOUBLE / total_claims', 2)} AS weekend_pct, {rnd('peer', 2)} AS peer_pct,
                {rnd('weekend_claims * 100.0::DOUBLE / total_claims - peer', 2)} AS difference
            FROM q_off w JOIN (SELECT specialty, sum(weekend_claims) * 100.0::DOUBLE / sum(total_claims) AS peer
                               FROM q_off GROUP BY specialty) s ON w.specialty = s.specialty""",
        {
            "q_days_off": """SELECT DISTINCT CAST(o_orderdate AS DATE) AS day FROM orders
                WHERE dayofmonth(CAST(o_orderdate AS DATE)) = 1""",
            "q_off": """SELECT provider_npi, specialty, count(*) FILTER (off) AS weekend_claims, count(*) AS total_claims,
                    coalesce(sum(allowed_amount) FILTER (off), 0) AS weekend_allowed
                FROM (SELECT c.*, specialty, dayofweek(service_date) IN (0, 6) OR day IS NOT NULL AS off
                      FROM period_claims c JOIN providers ON provider_npi = npi LEFT JOIN q_days_off ON day = service_date)
                GROUP BY 1, 2""",
        },
    ),
)

def gaps_without_late_cover(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Coverage that was recorded over 60 days late does not count."""
    on_time = F.date_diff("created_date", "coverage_start") <= 60
    return E.coverage_gap_claims(claims_tables(spark, sf_dir), START, END, counts_as_cover=on_time)


register(
    "coverage_gaps_some_cover",
    gaps_without_late_cover,
    with_needed(f"""SELECT c.claim_id, c.provider_npi, c.member_id, c.service_date, c.procedure_code,
            {dbl('c.allowed_amount')} AS allowed_amount
        FROM period_claims c WHERE NOT EXISTS (
            SELECT 1 FROM eligibility e WHERE c.member_id = e.member_id
               AND c.service_date BETWEEN e.coverage_start AND e.coverage_end
               AND date_diff('day', e.coverage_start, e.created_date) <= 60)"""),
)
_VOLUME = f"SELECT provider_npi, month, claim_count, {dbl('total_allowed')} AS total_allowed, avg_allowed FROM q_volume"
register(
    "volume_of_listed_providers",
    over_period(C.claim_volume_by_period, providers=["3", "17", "no such provider"]),
    with_needed(f"{_VOLUME} WHERE provider_npi IN ('3', '17')"),
)


def chosen_suppliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "supplier").where("s_acctbal > 0").select(F.col("s_suppkey").cast("string").alias("npi"))


register(
    "volume_of_chosen_providers",
    lambda spark, sf_dir: C.claim_volume_by_period(
        claims_tables(spark, sf_dir), START, END, chosen_suppliers(spark, sf_dir)
    ),
    with_needed(f"{_VOLUME} WHERE provider_npi IN (SELECT CAST(s_suppkey AS VARCHAR) FROM supplier WHERE s_acctbal > 0)"),
)


def paid_volume(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Claims without a referral count as denied, and denied ones are left out."""
    tables = claims_tables(spark, sf_dir)
    status = F.when(F.col("referring_npi").isNull(), "denied").otherwise("paid")
    marked = {**tables, "claims": tables["claims"].withColumn("claim_status", status)}
    return C.claim_volume_by_period(with_claims(marked, F.col("claim_status") == "paid"), START, END)


register(
    "volume_of_paid_claims",
    paid_volume,
    with_needed(f"""SELECT provider_npi, {month('service_date')} AS month, count(*) AS claim_count, {dbl('sum(allowed_amount)')} AS total_allowed,
            {rnd('CAST(sum(allowed_amount) AS DOUBLE) / count(allowed_amount)', 4)} AS avg_allowed
        FROM period_claims WHERE referring_npi IS NOT NULL GROUP BY 1, 2"""),
)


def shown_claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One provider's costly claims without the display limit."""
    return run(
        "high_cost_claims", claims_tables(spark, sf_dir),
        {"provider_npi": "3", "start_date": START, "end_date": END}, limit=None,
    )


register(
    "run_one_provider",
    shown_claims,
    with_needed(f"""SELECT claim_id, provider_npi, member_id, procedure_code,
        {dbl('allowed_amount')} AS allowed_amount, p95, cost_ratio FROM q_high_cost WHERE provider_npi = '3'"""),
)
