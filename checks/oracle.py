"""The same results as plain SQL, written independently of the DataFrame code."""

from __future__ import annotations

import re

from checks.testdata import END, START, VISIT_CODES

PERIOD = f"service_date BETWEEN DATE '{START}' AND DATE '{END}'"
CODES = "(" + ", ".join(f"'{c}'" for c in VISIT_CODES) + ")"


def rnd(expression: str, digits: int) -> str:
    """Half away from zero by floor, with the slack that ties need which doubles cannot hold."""
    scale, value = 10**digits, f"CAST({expression} AS DOUBLE)"
    return f"(floor(abs({value}) * {scale} * (1 + 5e-16) + 0.5) / {scale} * sign({value}) + 0.0)"


def dbl(expression: str) -> str:
    return f"CAST({expression} AS DOUBLE)"


def big(expression: str) -> str:
    return f"CAST({expression} AS BIGINT)"


def month(expression: str) -> str:
    return f"CAST(date_trunc('month', {expression}) AS DATE)"


# Named subqueries. ``with_needed`` puts those a query mentions at its head.
PARTS: dict[str, str] = {
    "providers": """
        SELECT CAST(s_suppkey AS VARCHAR) AS npi, 'S' || CAST(s_suppkey % 3 AS VARCHAR) AS specialty,
               r_name AS practice_state, n_name AS practice_city,
               CAST(s_nationkey AS VARCHAR) AS practice_zip, CAST(s_nationkey AS VARCHAR) AS tax_id
        FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey""",
    "members": """
        SELECT CAST(c_custkey AS VARCHAR) AS member_id, c_mktsegment AS employer_group
        FROM customer""",
    "eligibility": """
        SELECT CAST(o_orderkey AS VARCHAR) AS eligibility_id,
               o_custkey || CASE WHEN c_acctbal < -500 THEN '-X' WHEN c_acctbal > 9500 THEN '-Y' ELSE '' END AS member_id,
               CAST(o_orderdate AS DATE) AS coverage_start,
               CAST(o_orderdate AS DATE) + 180 AS coverage_end,
               CAST(o_orderdate AS DATE) + CAST(o_orderkey % 91 AS INTEGER) AS created_date
        FROM orders JOIN customer ON o_custkey = c_custkey""",
    "specialty_procedure_map": """
        SELECT * FROM (VALUES ('PROMO','S0'), ('PROMO','S1'), ('LARGE','S2'), ('SMALL','S0'))
               AS t(procedure_code, expected_specialty)""",
    "claims": """
        SELECT concat(l_orderkey,'-',l_linenumber,'-',l_partkey,'-',l_suppkey) AS claim_id,
               o_custkey || CASE WHEN c_acctbal <= 0 THEN '-X' ELSE '' END AS member_id,
               CAST(l_suppkey AS VARCHAR) AS provider_npi,
               CASE WHEN l_linenumber <= 2 THEN CAST(l_partkey % 10 AS VARCHAR) END AS referring_npi,
               CAST(l_shipdate AS DATE) AS service_date, p_type AS procedure_code,
               o_orderpriority AS diagnosis_code, r_name AS service_state,
               CAST(l_extendedprice AS DECIMAL(12,2)) AS allowed_amount
        FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey
             JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey
             JOIN region ON n_regionkey = r_regionkey JOIN customer ON o_custkey = c_custkey""",
    "period_claims": f"SELECT * FROM claims WHERE {PERIOD}",
    # High cost
    "q_limits": """
        SELECT procedure_code, service_state,
               CAST(quantile_cont(CAST(allowed_amount AS DOUBLE), 0.95) AS DECIMAL(26,6)) AS p95
        FROM period_claims GROUP BY procedure_code, service_state""",
    "q_high_cost": f"""
        SELECT c.claim_id, c.provider_npi, c.member_id, c.procedure_code, c.service_date,
               c.allowed_amount, {dbl('p.p95')} AS p95,
               {rnd('CAST(c.allowed_amount AS DOUBLE) / nullif(CAST(p.p95 AS DOUBLE), 0)', 2)} AS cost_ratio,
               CAST(c.allowed_amount AS DOUBLE) / nullif(CAST(p.p95 AS DOUBLE), 0) AS x_ratio
        FROM period_claims c JOIN q_limits p
          ON c.procedure_code = p.procedure_code AND c.service_state = p.service_state
        WHERE c.allowed_amount > p.p95""",
    # Code mix
    "q_own_mix": f"""
        SELECT provider_npi, procedure_code, count(*) AS n, sum(allowed_amount) AS allowed,
               count(*) * 100.0::DOUBLE / sum(count(*)) OVER (PARTITION BY provider_npi) AS pct
        FROM period_claims WHERE procedure_code IN {CODES} GROUP BY provider_npi, procedure_code""",
    "q_peer_mix": f"""
        SELECT specialty, procedure_code, count(*) AS n, sum(allowed_amount) AS allowed,
               count(*) * 100.0::DOUBLE / sum(count(*)) OVER (PARTITION BY specialty) AS pct
        FROM period_claims JOIN providers ON provider_npi = npi
        WHERE procedure_code IN {CODES} GROUP BY specialty, procedure_code""",
    "q_mix": """
        SELECT o.provider_npi, o.procedure_code, o.n, o.pct, q.pct AS peer_pct,
               q.n AS peer_n, q.allowed AS peer_allowed
        FROM q_own_mix o JOIN providers p ON o.provider_npi = p.npi
        JOIN q_peer_mix q ON q.specialty = p.specialty AND q.procedure_code = o.procedure_code""",
    "q_upcoding": f"""
        SELECT provider_npi, procedure_code, {rnd('pct', 1)} AS provider_pct,
               {rnd('peer_pct', 1)} AS peer_pct, {rnd('pct - peer_pct', 1)} AS delta
        FROM q_mix""",
    "q_duplicates": """
        SELECT provider_npi, member_id, procedure_code, service_date, count(*) AS claim_count,
               sum(allowed_amount) AS total_allowed, max(allowed_amount) AS dearest
        FROM period_claims GROUP BY ALL HAVING count(*) > 1""",
    "q_volume": f"""
        SELECT provider_npi, {month('service_date')} AS month, count(*) AS claim_count,
               sum(allowed_amount) AS total_allowed,
               {rnd('CAST(sum(allowed_amount) AS DOUBLE) / count(allowed_amount)', 4)} AS avg_allowed
        FROM period_claims GROUP BY 1, 2""",
    # Peers
    "q_totals": f"""
        SELECT provider_npi, count(*) AS total_claims, sum(allowed_amount) AS total_allowed,
               {rnd('CAST(sum(allowed_amount) AS DOUBLE) / count(allowed_amount)', 4)} AS avg_allowed,
               count(DISTINCT member_id) AS unique_patients
        FROM period_claims GROUP BY provider_npi""",
    "q_peer_stats": f"""
        SELECT specialty, practice_state,
               avg({dbl('total_claims')}) AS mc, stddev_samp({dbl('total_claims')}) AS sc,
               avg({dbl('total_allowed')}) AS ma, stddev_samp({dbl('total_allowed')}) AS sa
        FROM q_totals JOIN providers ON provider_npi = npi GROUP BY specialty, practice_state""",
    "q_peers": f"""
        SELECT t.*, {rnd('(total_claims - mc) / nullif(sc, 0)', 2)} AS z_claims,
               {rnd('(CAST(total_allowed AS DOUBLE) - ma) / nullif(sa, 0)', 2)} AS z_allowed,
               greatest((total_claims - mc) / nullif(sc, 0), (CAST(total_allowed AS DOUBLE) - ma) / nullif(sa, 0)) AS x_max
        FROM q_totals t LEFT JOIN providers p ON t.provider_npi = p.npi
        LEFT JOIN q_peer_stats s ON s.specialty = p.specialty AND s.practice_state = p.practice_state""",
    "q_mismatch": """
        SELECT c.provider_npi, c.procedure_code, c.service_date, c.allowed_amount,
               p.specialty AS provider_specialty, m.listed AS procedure_specialty
        FROM period_claims c JOIN providers p ON c.provider_npi = p.npi
        JOIN (SELECT procedure_code, string_agg(expected_specialty, '|' ORDER BY expected_specialty) AS listed
              FROM specialty_procedure_map GROUP BY procedure_code) m ON c.procedure_code = m.procedure_code
        WHERE NOT EXISTS (SELECT 1 FROM specialty_procedure_map x
                          WHERE x.procedure_code = c.procedure_code AND x.expected_specialty = p.specialty)""",
    # Members
    "q_visits": """
        SELECT DISTINCT member_id, diagnosis_code, service_date, provider_npi FROM period_claims""",
    "q_seen30": """
        SELECT a.member_id, a.diagnosis_code, a.service_date,
               count(DISTINCT b.provider_npi) AS provider_count_30d
        FROM (SELECT DISTINCT member_id, diagnosis_code, service_date FROM q_visits) a
        JOIN q_visits b ON a.member_id = b.member_id AND a.diagnosis_code = b.diagnosis_code
         AND b.service_date BETWEEN a.service_date - 30 AND a.service_date
        GROUP BY ALL""",
    "q_util_months": f"""
        SELECT provider_npi, member_id, {month('service_date')} AS month, count(*) AS monthly_claims
        FROM claims WHERE service_date BETWEEN DATE '1999-07-01' AND DATE '{END}' GROUP BY 1, 2, 3""",
    "q_util_avg": """
        SELECT *, avg(monthly_claims) OVER (PARTITION BY provider_npi, member_id ORDER BY month
                  ROWS BETWEEN 6 PRECEDING AND 1 PRECEDING) AS usual FROM q_util_months""",
    "q_util": f"""
        SELECT provider_npi, member_id, month, monthly_claims, {rnd('usual', 1)} AS avg_6m,
               {rnd('monthly_claims / nullif(usual, 0)', 1)} AS spike_ratio, monthly_claims / nullif(usual, 0) AS x_ratio
        FROM q_util_avg WHERE month >= DATE '{START}' AND monthly_claims > 3 * coalesce(usual, 0)""",
    # Eligibility
    "q_gaps": """
        SELECT c.claim_id, c.provider_npi, c.member_id, c.service_date, c.procedure_code, c.allowed_amount
        FROM period_claims c LEFT JOIN eligibility e ON c.member_id = e.member_id
         AND c.service_date BETWEEN e.coverage_start AND e.coverage_end
        WHERE e.member_id IS NULL""",
    "q_late": "SELECT * FROM eligibility WHERE date_diff('day', coverage_start, created_date) > 30",
    "q_retro": """
        SELECT c.provider_npi, e.member_id, e.coverage_start, e.coverage_end, e.created_date,
               date_diff('day', e.coverage_start, e.created_date) AS days_retroactive,
               count(c.claim_id) AS claims_in_period, sum(c.allowed_amount) AS total_allowed
        FROM q_late e JOIN period_claims c ON e.member_id = c.member_id
         AND c.service_date BETWEEN e.coverage_start AND e.coverage_end
        GROUP BY ALL""",
    # Time
    "q_months": f"""
        SELECT provider_npi, {month('service_date')} AS month, count(*) AS claims,
               sum(allowed_amount) AS total_allowed
        FROM claims WHERE service_date BETWEEN DATE '1998-01-01' AND DATE '{END}' GROUP BY 1, 2""",
    "q_rolling": f"""
        SELECT *, avg({dbl('total_allowed')}) OVER w AS ra, stddev_samp({dbl('total_allowed')}) OVER w AS rs
        FROM q_months WINDOW w AS (PARTITION BY provider_npi ORDER BY month
                                   ROWS BETWEEN 12 PRECEDING AND 1 PRECEDING)""",
    "q_spikes": f"""
        SELECT provider_npi, month, claims, total_allowed, {rnd('ra', 2)} AS rolling_avg,
               {rnd('rs', 2)} AS rolling_std,
               {rnd('(CAST(total_allowed AS DOUBLE) - ra) / nullif(rs, 0)', 2)} AS z_score,
               (CAST(total_allowed AS DOUBLE) - ra) / nullif(rs, 0) AS x_score
        FROM q_rolling WHERE month >= DATE '{START}'
          AND (CAST(total_allowed AS DOUBLE) - ra) / nullif(rs, 0) > 2""",
    # Network
    "q_edges": """
        SELECT referring_npi, provider_npi AS rendering_npi, count(*) AS referral_count,
               sum(allowed_amount) AS total_allowed, count(DISTINCT member_id) AS unique_patients
        FROM period_claims WHERE referring_npi IS NOT NULL GROUP BY 1, 2""",
    "q_ends": """
        SELECT referring_npi AS provider_npi, * FROM q_edges
        UNION ALL
        SELECT rendering_npi AS provider_npi, * FROM q_edges WHERE rendering_npi <> referring_npi""",
    "q_pairs": f"""
        SELECT a.provider_npi, b.provider_npi AS other_provider,
               count(DISTINCT a.member_id) AS shared_patients, count(*) AS combined_claims
        FROM period_claims a JOIN claims b ON a.member_id = b.member_id
         AND a.provider_npi <> b.provider_npi AND abs(date_diff('day', a.service_date, b.service_date)) <= 7
        GROUP BY 1, 2""",
    # Signals
    "q_weekend": f"""
        SELECT provider_npi, specialty, count(*) FILTER (dayofweek(service_date) IN (0, 6)) AS weekend_claims,
               count(*) AS total_claims,
               coalesce(sum(allowed_amount) FILTER (dayofweek(service_date) IN (0, 6)), 0) AS weekend_allowed
        FROM period_claims JOIN providers ON provider_npi = npi GROUP BY 1, 2""",
    "q_weekend_share": f"""
        SELECT w.*, {rnd('w.weekend_claims * 100.0::DOUBLE / w.total_claims', 2)} AS weekend_pct,
               {rnd('peer', 2)} AS peer_pct,
               {rnd('w.weekend_claims * 100.0::DOUBLE / w.total_claims - peer', 2)} AS difference,
               w.weekend_claims * 100.0::DOUBLE / w.total_claims - peer AS x_difference
        FROM q_weekend w JOIN (SELECT specialty, sum(weekend_claims) * 100.0::DOUBLE / sum(total_claims) AS peer
                               FROM q_weekend GROUP BY specialty) s ON w.specialty = s.specialty""",
    "q_ramp": f"""
        SELECT provider_npi, month, total_allowed, before AS previous_allowed,
               {rnd('CAST(total_allowed AS DOUBLE) / nullif(CAST(before AS DOUBLE), 0)', 2)} AS ramp_ratio,
               CAST(total_allowed AS DOUBLE) / nullif(CAST(before AS DOUBLE), 0) AS x_ratio
        FROM (SELECT *, lag(total_allowed) OVER (PARTITION BY provider_npi ORDER BY month) AS before FROM q_volume)
        WHERE CAST(total_allowed AS DOUBLE) / nullif(CAST(before AS DOUBLE), 0) >= 2""",
    "q_concentration": f"""
        SELECT provider_npi, referring_npi AS top_referrer, referral_count AS top_referrals,
               CAST(total AS BIGINT) AS total_referrals, referrers,
               {rnd('referral_count / total', 4)} AS top_share, referral_count / total AS x_share
        FROM (SELECT rendering_npi AS provider_npi, referring_npi, referral_count,
                     sum(referral_count) OVER (PARTITION BY rendering_npi) AS total,
                     count(*) OVER (PARTITION BY rendering_npi) AS referrers,
                     row_number() OVER (PARTITION BY rendering_npi
                                        ORDER BY referral_count DESC, referring_npi) AS place FROM q_edges)
        WHERE place = 1""",
    "q_phantom": """
        SELECT claim_id, provider_npi, member_id, service_date, allowed_amount,
               CASE WHEN m.id IS NULL AND e.id IS NULL THEN 'no_member_no_eligibility'
                    WHEN m.id IS NULL THEN 'no_member' WHEN e.id IS NULL THEN 'no_eligibility' END AS reason
        FROM period_claims LEFT JOIN (SELECT DISTINCT member_id AS id FROM members) m ON member_id = m.id
             LEFT JOIN (SELECT DISTINCT member_id AS id FROM eligibility) e ON member_id = e.id
        WHERE m.id IS NULL OR e.id IS NULL""",
    "q_spike_claims": f"""
        SELECT c.provider_npi, s.month, c.member_id, s.total_allowed AS spike_allowed
        FROM period_claims c JOIN q_spikes s
          ON c.provider_npi = s.provider_npi AND {month('c.service_date')} = s.month""",
    "q_signal_pairs": f"""
        SELECT 'billing_and_utilisation' AS pair, s.provider_npi, s.month, count(*) AS signals,
               any_value(s.total_allowed) AS amount
        FROM q_spikes s JOIN q_util u ON s.provider_npi = u.provider_npi AND s.month = u.month GROUP BY 2, 3
        UNION ALL
        SELECT 'retroactive_and_high_cost', provider_npi, {month('service_date')}, count(*), sum(allowed_amount)
        FROM q_high_cost h WHERE EXISTS (SELECT 1 FROM q_late e WHERE e.member_id = h.member_id
             AND h.service_date BETWEEN e.coverage_start AND e.coverage_end) GROUP BY 2, 3
        UNION ALL
        SELECT 'billing_and_enrolment', provider_npi, month, count(DISTINCT member_id), any_value(spike_allowed)
        FROM q_spike_claims c WHERE EXISTS (SELECT 1 FROM eligibility e WHERE e.member_id = c.member_id
             AND date_trunc('month', e.coverage_start) = c.month) GROUP BY 2, 3""",
    "q_employers": f"""
        SELECT provider_npi, month, employer_group, n AS employer_claims, CAST(total AS BIGINT) AS total_claims
        FROM (SELECT *, sum(n) OVER (PARTITION BY provider_npi, month) AS total
              FROM (SELECT provider_npi, month, employer_group, count(*) AS n
                    FROM q_spike_claims LEFT JOIN members USING (member_id) GROUP BY 1, 2, 3))
        WHERE employer_group IS NOT NULL
        QUALIFY row_number() OVER (PARTITION BY provider_npi, month ORDER BY n DESC, employer_group) = 1""",
    # Findings: bounds are strict, a finding needs a score above ``low``.
    "q_rules": """
        SELECT * FROM (VALUES
            ('high_cost_claims', 'claims', 'outlier', 3, 2, 1.5, 1),
            ('upcoding_pattern', 'claims', 'pattern', 30, 20, 10, 5),
            ('duplicate_claims', 'claims', 'anomaly', 5, 3, 2, 1),
            ('claim_volume_by_period', 'claims', 'pattern', 10, 5, 3, 2),
            ('provider_peer_comparison', 'provider', 'outlier', 3, 2, 2, 2),
            ('provider_specialty_mismatch', 'provider', 'anomaly', 100, 50, 10, 0),
            ('doctor_shopping', 'member', 'pattern', 8, 6, 5, 3),
            ('member_utilization_spike', 'member', 'anomaly', 10, 7, 5, 3),
            ('coverage_gap_claims', 'eligibility', 'anomaly', 100, 50, 10, 0),
            ('retroactive_eligibility', 'eligibility', 'anomaly', 90, 60, 45, 30),
            ('billing_spike_detection', 'temporal', 'outlier', 3, 2, 2, 2),
            ('weekend_billing', 'temporal', 'pattern', 30, 20, 10, 5),
            ('referral_network', 'network', 'pattern', 0.9, 0.75, 0.5, 0.5),
            ('shared_patients', 'network', 'correlation', 20, 10, 5, 2)
        ) AS t(concept, domain, finding_type, critical, high, medium, low)""",
    "q_upcoding_cost": f"""
        SELECT provider_npi, count(*) AS n,
               sum(pct - peer_pct) FILTER (procedure_code IN {VISIT_CODES[-2:]}) AS score, sum(allowed) AS amount,
               greatest({rnd('sum((n - peer_pct / 100 * total) * CAST(peer_allowed AS DOUBLE) / peer_n)', 2)}, 0) AS rec
        FROM (SELECT x.*, o.allowed, sum(x.n) OVER (PARTITION BY x.provider_npi) AS total
              FROM q_mix x JOIN q_own_mix o USING (provider_npi, procedure_code))
        GROUP BY provider_npi""",
    "q_shopping": """
        SELECT c.provider_npi, c.member_id, c.diagnosis_code, s.k AS provider_count_30d,
               count(*) AS claims, sum(c.allowed_amount) AS total_allowed
        FROM period_claims c JOIN (SELECT member_id, diagnosis_code, max(provider_count_30d) AS k FROM q_seen30
                                   WHERE provider_count_30d >= 4 GROUP BY 1, 2) s
          ON c.member_id = s.member_id AND c.diagnosis_code = s.diagnosis_code GROUP BY 1, 2, 3, 4""",
    "q_partners": "SELECT * FROM q_pairs WHERE shared_patients >= 3",
    "q_scores": """
        SELECT 'high_cost_claims' AS concept, provider_npi, count(*) AS n, max(x_ratio) AS score,
               CAST(sum(allowed_amount) AS DOUBLE) AS amount, CAST(0 AS DOUBLE) AS rec FROM q_high_cost GROUP BY 2
        UNION ALL SELECT 'upcoding_pattern', provider_npi, n, coalesce(score, 0), amount, rec FROM q_upcoding_cost
        UNION ALL SELECT 'duplicate_claims', provider_npi, count(*), max(claim_count), sum(total_allowed),
               sum(total_allowed) FROM q_duplicates GROUP BY 2
        UNION ALL SELECT 'claim_volume_by_period', provider_npi, count(*), max(x_ratio), sum(total_allowed), 0
               FROM q_ramp GROUP BY 2
        UNION ALL SELECT 'provider_peer_comparison', provider_npi, count(*), max(x_max),
               sum(total_allowed), 0 FROM q_peers GROUP BY 2
        UNION ALL SELECT 'provider_specialty_mismatch', provider_npi, count(*), count(*), sum(allowed_amount), 0
               FROM q_mismatch GROUP BY 2
        UNION ALL SELECT 'doctor_shopping', provider_npi, count(*), max(provider_count_30d), sum(total_allowed), 0
               FROM q_shopping GROUP BY 2
        UNION ALL SELECT 'member_utilization_spike', provider_npi, count(*), max(x_ratio), 0, 0
               FROM q_util WHERE spike_ratio IS NOT NULL GROUP BY 2
        UNION ALL SELECT 'coverage_gap_claims', provider_npi, count(*), count(*), sum(allowed_amount),
               sum(allowed_amount) FROM q_gaps GROUP BY 2
        UNION ALL SELECT 'retroactive_eligibility', provider_npi, count(*), max(days_retroactive),
               sum(total_allowed), 0 FROM q_retro GROUP BY 2
        UNION ALL SELECT 'billing_spike_detection', provider_npi, count(*), max(x_score), sum(total_allowed), 0
               FROM q_spikes GROUP BY 2
        UNION ALL SELECT 'weekend_billing', provider_npi, count(*), max(x_difference), sum(weekend_allowed), 0
               FROM q_weekend_share GROUP BY 2
        UNION ALL SELECT 'referral_network', provider_npi, count(*), max(x_share), 0, 0
               FROM q_concentration GROUP BY 2
        UNION ALL SELECT 'shared_patients', provider_npi, count(*), max(shared_patients), 0, 0
               FROM q_partners GROUP BY 2""",
    "q_findings": f"""
        SELECT s.provider_npi, r.domain, s.concept, r.finding_type,
               CASE WHEN score > critical THEN 'critical' WHEN score > high THEN 'high'
                    WHEN score > medium THEN 'medium' ELSE 'low' END AS severity,
               CAST(CASE WHEN score > critical THEN 1 WHEN score > high THEN 0.75
                    WHEN score > medium THEN 0.5 ELSE 0.25 END AS DOUBLE) AS confidence,
               CAST(n AS DOUBLE) AS row_count, {rnd('score', 4)} AS score,
               CAST(amount AS DOUBLE) AS amount, CAST(rec AS DOUBLE) AS recoverable
        FROM q_scores s JOIN q_rules r ON s.concept = r.concept WHERE score > low""",
    "q_overpayment": """
        SELECT provider_npi, CAST(sum(a) AS DOUBLE) AS upcoding, CAST(sum(b) AS DOUBLE) AS duplicates,
               CAST(sum(c) AS DOUBLE) AS duplicate_copies, CAST(sum(d) AS DOUBLE) AS coverage_gaps,
               CAST(sum(f) AS DOUBLE) AS uncovered_once, CAST(sum(e) AS DOUBLE) AS mismatch_review
        FROM (SELECT provider_npi, rec AS a, 0.00 AS b, 0.00 AS c, 0.00 AS d, 0.00 AS e, 0.00 AS f FROM q_upcoding_cost
              UNION ALL SELECT provider_npi, 0, total_allowed, total_allowed - dearest, 0, 0, 0 FROM q_duplicates
              UNION ALL SELECT provider_npi, 0, 0, 0, allowed_amount, 0, 0 FROM q_gaps
              UNION ALL SELECT provider_npi, 0, 0, 0, 0, 0, max(allowed_amount) FROM q_gaps
                        GROUP BY provider_npi, member_id, procedure_code, service_date
              UNION ALL SELECT provider_npi, 0, 0, 0, 0, allowed_amount, 0 FROM q_mismatch)
        GROUP BY provider_npi""",
    "q_impact": f"""
        SELECT provider_npi, {rnd('duplicate_copies + uncovered_once', 2)} AS impact_low,
               {rnd('duplicates + coverage_gaps + upcoding', 2)} AS impact_mid,
               {rnd('duplicates + coverage_gaps + upcoding + mismatch_review', 2)} AS impact_high,
               {rnd('(duplicates + coverage_gaps + upcoding) * 365 / 366', 2)} AS annualized_exposure
        FROM q_overpayment""",
    "q_ranked": """
        SELECT provider_npi, concept, severity, recoverable, confidence,
               CAST(row_number() OVER (PARTITION BY provider_npi
                    ORDER BY recoverable DESC, confidence DESC, concept) AS INTEGER) AS impact_rank
        FROM q_findings""",
    "q_risk": f"""
        SELECT *, CASE WHEN composite_risk_score >= 0.75 THEN 'critical' WHEN composite_risk_score >= 0.6 THEN 'high'
                       WHEN composite_risk_score >= 0.3 THEN 'medium' ELSE 'low' END AS risk_category
        FROM (SELECT provider_npi, {rnd('sum(weight * heaviest)', 4)} AS composite_risk_score, count(*) AS domains
              FROM (SELECT provider_npi, domain, max(confidence) AS heaviest FROM q_findings GROUP BY 1, 2)
              JOIN (VALUES ('claims', 0.25), ('provider', 0.2), ('member', 0.15), ('eligibility', 0.15),
                           ('temporal', 0.15), ('network', 0.1)) AS w(domain, weight) USING (domain)
              GROUP BY provider_npi)""",
    "q_report": """
        SELECT provider_npi, coalesce(total_findings, 0) AS total_findings,
               coalesce(critical_findings, 0) AS critical_findings, coalesce(high_findings, 0) AS high_findings,
               coalesce(medium_findings, 0) AS medium_findings, coalesce(low_findings, 0) AS low_findings,
               coalesce(composite_risk_score, 0) AS composite_risk_score,
               coalesce(risk_category, 'low') AS risk_category,
               coalesce(impact_low, 0) AS impact_low, coalesce(impact_mid, 0) AS impact_mid,
               coalesce(impact_high, 0) AS impact_high, coalesce(annualized_exposure, 0) AS annualized_exposure,
               top_findings
        FROM (SELECT provider_npi, count(*) AS total_findings,
                     count(*) FILTER (severity = 'critical') AS critical_findings,
                     count(*) FILTER (severity = 'high') AS high_findings,
                     count(*) FILTER (severity = 'medium') AS medium_findings,
                     count(*) FILTER (severity = 'low') AS low_findings,
                     string_agg(concept || ':' || severity, ',' ORDER BY impact_rank) AS top_findings
              FROM q_ranked GROUP BY provider_npi)
        JOIN q_risk USING (provider_npi) FULL JOIN q_impact USING (provider_npi)""",
}


def with_needed(select: str, parts: dict[str, str] | None = None, recursive: bool = False) -> str:
    """Prefix ``select`` with the named subqueries it needs, dependencies first."""
    known = {**PARTS, **(parts or {})}
    order: list[str] = []

    def visit(text: str) -> None:
        for name in known:
            if name not in order and re.search(rf"\b{name}\b", text) and known[name] is not text:
                visit(known[name])
                if name not in order:
                    order.append(name)

    visit(select)
    head = ",\n".join(f"{name} AS ({known[name]})" for name in order)
    return f"WITH {'RECURSIVE ' if recursive else ''}{head}\n{select}" if order else select
