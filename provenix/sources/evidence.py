"""Evidence tables: derived views over the star-schema tables, the same SQL for Spark and for the SQL that checks it."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events")
_SCOPE = "concat('t', cast(o_custkey % 4 as string)) tenant_id, concat('t', cast(o_custkey % 4 as string), ':orders:1') boundary_ref"
_LINK = "from orders join population_items on destination_record_id = concat('d', cast(o_orderkey as string))"

VIEWS: dict[str, str] = {
    # one population per tenant and month
    "population_items": f"""select {_SCOPE},
        concat('t', cast(o_custkey % 4 as string), ':', cast(year(o_orderdate) * 100 + month(o_orderdate) as string)) population_ref,
        concat('d', cast(o_orderkey as string)) destination_record_id, 'order.create' action_family, 'erp' destination_system, o_orderdate authoritative_time
        from orders""",
    "populations": """select tenant_id, boundary_ref, population_ref, action_family, destination_system, count(*) signed_count,
        date_trunc('month', min(authoritative_time)) window_start, date_trunc('month', min(authoritative_time)) + interval '1' month window_end,
        min(authoritative_time) ts_min, max(authoritative_time) ts_max,
        cast(substr(population_ref, 4) as bigint) % 7 = 0 result_cap_hit, cast(substr(population_ref, 4) as bigint) % 11 <> 0 pagination_complete
        from population_items group by tenant_id, boundary_ref, population_ref, action_family, destination_system""",
    # missing for keys % 10 = 0; shared action for % 53, one action of many records of a tenant for % 31; second attempt for % 41
    "receipts": """select tenant_id, boundary_ref, destination_record_id,
        case when k % 31 = 0 then concat('shared-', tenant_id) when k % 53 = 0 then concat('a', cast(k - 1 as string)) else concat('a', cast(k as string)) end action_id,
        concat('r', cast(k as string), '-', cast(dispatch_attempt as string)) record_id, dispatch_attempt, responded_at
        from (select p.*, o.o_orderkey k, l.l_linenumber dispatch_attempt, o.o_orderdate + interval '2' minute responded_at
              from orders o join lineitem l on l.l_orderkey = o.o_orderkey
              join (select destination_record_id, tenant_id, boundary_ref from population_items) p on p.destination_record_id = concat('d', cast(o.o_orderkey as string))
              where o.o_orderkey % 10 <> 0 and (l.l_linenumber = 1 or (l.l_linenumber = 2 and o.o_orderkey % 41 = 0))) q""",
    # missing for % 7 = 0; other destination for % 61; content twins for % 29 in (0, 1)
    "confirmations": f"""select tenant_id, boundary_ref, destination_record_id, concat('a', cast(o_orderkey as string)) action_id,
        case when o_orderkey % 61 = 0 then 'crm' else 'erp' end destination_system,
        concat('sha256:', sha2(concat('o', cast(case when o_orderkey % 29 = 1 then o_orderkey - 1 else o_orderkey end as string)), 256)) destination_record_digest,
        concat('c', cast(o_orderkey as string)) record_id, o_orderdate authoritative_time {_LINK} where o_orderkey % 7 <> 0""",
    # missing for % 13 = 0; other family for % 59
    "proposals": f"""select tenant_id, boundary_ref, concat('a', cast(o_orderkey as string)) action_id,
        case when o_orderkey % 59 = 0 then 'order.cancel' else 'order.create' end action_family,
        concat('p', cast(o_orderkey as string)) record_id, o_orderdate - interval '1' hour proposed_at {_LINK} where o_orderkey % 13 <> 0""",
    "human_reviews": f"""select tenant_id, boundary_ref, concat('h', cast(o_orderkey as string)) record_id, concat('a', cast(o_orderkey as string)) action_id,
        case substr(o_orderpriority, 1, 1) when '1' then 'committed' when '2' then 'irreversible' else 'pending' end action_state_at_review,
        case when o_orderkey % 17 = 0 then 'server_reconstructed' when o_orderkey % 19 = 0 then 'copied' when o_orderkey % 3 = 0 then 'client_rendered' end evidence_shown_provenance,
        o_orderdate + cast(o_orderkey % 40 as int) * interval '1' day decided_at {_LINK} where o_orderkey % 4 <> 0""",
    "outcomes": f"""select tenant_id, boundary_ref, concat('a', cast(o_orderkey as string)) action_id, case when o_orderkey % 5 = 0 then 'bank' else 'erp' end authoritative_source,
        o_orderkey % 6 = 0 disputed, o_orderdate + interval '9' day finalised_at {_LINK} where o_orderstatus = 'F'""",
    "stream_base": """select concat('t', cast(user_id % 3 as string)) tenant_id, concat('u', cast(user_id as string)) stream_id,
        cast(row_number() over (partition by user_id order by ts, event_id) as bigint) sequence, event_id, ts source_time, event_type,
        concat('sha256:', sha2(concat_ws('|', cast(event_id as string), cast(user_id as string), event_type), 256)) record_digest from events""",
    # holes % 97, tampered links % 89, key change every 25, unsigned % 211, no continuity % 83
    "stream_records": """select tenant_id, stream_id, sequence, concat('e', cast(event_id as string)) record_id, source_time, event_type, event_id, record_digest,
        case when event_id % 89 = 0 then 'sha256:tampered' else prev end prev_digest, concat('k', cast((cast(substr(stream_id, 2) as bigint) + (sequence - 1) div 25) % (select greatest(1, count(*) div 12) from supplier) as string)) key_id,
        event_id % 83 <> 0 has_continuity, event_id % 211 <> 0 sig_ok
        from (select b.*, lag(record_digest) over (partition by tenant_id, stream_id order by sequence) prev from stream_base b) q where event_id % 97 <> 0""",
    # every 150th position is filed again under another id; every 130th exactly again
    "filed_records": """select * from stream_records union all
        select tenant_id, stream_id, sequence, concat(record_id, 'x'), source_time, event_type, event_id, concat(record_digest, 'f'), prev_digest, key_id, has_continuity, event_id % 4 <> 0 sig_ok from stream_records where event_id % 150 = 0
        union all select * from stream_records where event_id % 130 = 0""",
    "gaps": """select concat('t', cast(user_id % 3 as string)) tenant_id, concat('t', cast(user_id % 3 as string), ':', date_format(ts, 'yyyyMMdd')) window_ref,
        cast(event_id as bigint) gap_id, ts gap_start, ts + interval '15' minute gap_end,
        case when event_id % 2 = 0 then 'collector_unreachable' else 'denominator_unavailable' end cause, date_trunc('day', ts) window_start, date_trunc('day', ts) + interval '1' day window_end
        from events where event_type = 'error' and hour(ts) < 23""",
    "windows": """select distinct concat('t', cast(user_id % 3 as string)) tenant_id, concat('t', cast(user_id % 3 as string), ':', date_format(ts, 'yyyyMMdd')) window_ref,
        date_trunc('day', ts) window_start, date_trunc('day', ts) + interval '1' day window_end from events""",
    "occurrences": """select concat('t', cast(user_id % 3 as string)) tenant_id, concat('t', cast(user_id % 3 as string), ':', date_format(ts, 'yyyyMMdd')) window_ref,
        concat('e', cast(event_id as string)) action_id, ts occurred_at, event_id % 3 = 0 is_matched, event_id % 37 = 0 is_skewed from events""",
    "qualifications": """select concat('q', cast(s_suppkey as string)) qualification_ref, concat('t', cast(s_suppkey % 4 as string)) tenant_id, 'order.create' action_family, 'erp' destination_system,
        concat('c', cast(1 + (s_suppkey * 7) % 5 as string)) assigned_class, (s_suppkey * 7) % 5 < 3 enumeration_capable, s_suppkey % 6 <> 0 authoritative_time_available,
        case when s_suppkey % 8 <> 0 then 'actor' end identity_isolation_attribute, s_suppkey % 5 = 0 identity_vendor_settable, s_suppkey % 4 = 1 deletion_traceless_possible,
        cast(30 + s_suppkey % 90 as int) source_retention_days, cast(s_suppkey % 4000 as int) settlement_lag_s, concat('P', cast(1 + s_suppkey % 18 as string), 'M') cadence,
        timestamp '1995-01-01 00:00:00' + cast(s_suppkey * 24 as int) * interval '1' day qualified_at,
        timestamp '1995-01-01 00:00:00' + cast(s_suppkey * 24 + case when s_suppkey % 9 = 0 then 400 else 0 end as int) * interval '1' day recorded_at from supplier""",
    "boundaries": """select concat('t', cast(n_nationkey % 4 as string), ':b', cast(n_regionkey as string), ':', cast(v as string)) boundary_ref, concat('t', cast(n_nationkey % 4 as string)) tenant_id,
        concat('b', cast(n_regionkey as string)) name, v version, timestamp '1995-01-01 00:00:00' window_start, timestamp '1996-01-01 00:00:00' window_end,
        timestamp '1994-12-01 00:00:00' + cast(v * 61 + n_regionkey * 9 as int) * interval '1' day recorded_at, (n_nationkey + v) % 5 <> 0 recording_time_attested
        from (select n_regionkey, min(n_nationkey) n_nationkey, cast(row_number() over (partition by n_regionkey, min(n_nationkey) % 4 order by min(n_nationkey)) as int) v
              from nation group by n_regionkey, n_nationkey) q""",
    "boundary_families": """select b.boundary_ref, b.tenant_id, b.name, b.version, concat('family.', cast(f as string)) action_family, 'erp' destination_system, 'fail_closed' fail_behaviour
        from boundaries b join (select distinct p_size f from part where p_size <= 12) p on (f + b.version) % 3 <> 0""",
    "attestations": """select concat('att-', population_ref) attestation_id, tenant_id, boundary_ref, population_ref, window_start, window_end, window_end issued_at,
        window_end + interval '5' day validity_from, window_end + interval '180' day validity_until, concat('c', cast(1 + signed_count % 5 as string)) claimed_class from populations""",
    "revocations": """select concat('rev-', population_ref, '-', cast(s as string)) revocation_id, tenant_id, concat('att-', population_ref) attestation_id, cast(s as bigint) sequence,
        window_end + cast(s * 30 as int) * interval '1' day effective_at, case when (signed_count + s) % 2 = 0 then concat('att-', population_ref, '-next') end superseding_attestation_id,
        case when (signed_count + s) % 2 = 0 then 'late_evidence' else 'error' end reason
        from populations, (select distinct r_regionkey s from region where r_regionkey in (1, 2)) r where signed_count % 3 = s % 3""",
    "permission_checks": """select concat('t', cast(user_id % 3 as string), ':', cast(user_id % 20 as string)) scope, event_id check_id, ts checked_at,
        case when event_id % 5 = 0 then 'confirmed-granted' when event_id % 7 = 0 then 'check-failed' else 'confirmed-clean' end outcome from events where event_type = 'signup'""",
    "ingest_receipts": """select concat('e', cast(event_id as string)) record_id, source_time, source_time + cast(event_id % 13 - 4 as int) * interval '1' second ingest_time,
        case when event_id % 31 = 0 then 0 else (event_id % 13 - 4) * 1000 end clock_skew_ms, case when event_id % 43 = 0 then 'sha256:other' else record_digest end receipt_digest, record_digest, event_id % 211 <> 0 sig_ok,
        case when event_id % 101 = 0 then 'evidence' else 'issuer' end key_namespace from stream_base""",
    "collectors": """select concat('t', cast(s_suppkey % 3 as string)) tenant_id, concat('col', cast(s_suppkey as string)) collector_id, cast(s_suppkey % 3 as int) version,
        case when s_suppkey % 4 = 0 then timestamp '2024-01-15 00:00:00' end revoked_at, s_suppkey % 5 = 0 observation_only, cast(600 + s_suppkey % 3 * 600 as int) expected_cadence_s from supplier""",
    "keys": """select concat('t', cast(s_suppkey % 3 as string)) tenant_id, concat('k', cast(s_suppkey % (select greatest(1, count(*) div 12) from supplier) as string)) key_id, concat('kr', cast(s_suppkey as string)) key_record,
        case when s_suppkey % 2 = 0 then 'evidence' else 'issuer' end namespace, timestamp '2024-01-01 00:00:00' + cast(s_suppkey % 20 as int) * interval '1' day valid_from,
        timestamp '2024-01-11 00:00:00' + cast(s_suppkey % 25 as int) * interval '1' day valid_until, case when s_suppkey % 7 = 0 then timestamp '2024-01-14 00:00:00' end compromised_from from supplier""",
    # every record; some are sent again (1), with other content (2), or their place is claimed by another id (3); some appear in other streams (4, 5), where
    # another id then takes the place that was refused to them (6). submission_id is the order of arrival.
    "submissions": """select tenant_id, case sent when 4 then concat(stream_id, 'b') when 5 then concat(stream_id, 'c') when 6 then concat(stream_id, 'b') else stream_id end stream_id,
        concat(case sent when 3 then 'z' when 6 then 'y' else 'e' end, cast(event_id as string)) record_id, cast(sequence as bigint) sequence,
        case when sent in (2, 5) then concat(record_digest, '-other') else record_digest end wire_digest, cast(event_id * 8 + sent as bigint) submission_id, source_time, cast(sent as int) sent,
        concat('col', cast(1 + event_id % (select greatest(1, count(*) * 7 div 6) from supplier) as string)) collector_id, cast(event_id % 4 as int) collector_version
        from stream_base, (select 0 sent union all select 1 union all select 2 union all select 3 union all select 4 union all select 5 union all select 6) again
        where sent = 0 or (sent = 1 and event_id % 23 = 0) or (sent = 2 and event_id % 29 = 0) or (sent = 3 and event_id % 37 = 0) or (sent = 4 and event_id % 41 = 0) or (sent = 5 and event_id % 43 = 0) or (sent = 6 and event_id % 41 = 0)""",
    # registries of the validated ingest: half of the collectors name an implementation; a key for each collector
    "registered_collectors": """select tenant_id, collector_id, cast(version as string) version, revoked_at, case when cast(substr(collector_id, 4) as bigint) % 2 = 0 then 'sdk' end implementation from collectors""",
    "collector_keys": """select concat('t', cast(s_suppkey % 3 as string)) tenant_id, concat('ck', cast(s_suppkey as string)) key_id, concat('col', cast(s_suppkey as string)) collector_id, case when s_suppkey % 10 = 0 then 'issuer' else 'evidence' end namespace,
        timestamp '2024-01-01 00:00:00' + cast(s_suppkey % 6 as int) * interval '1' day valid_from, case when s_suppkey % 9 <> 0 then timestamp '2024-01-18 00:00:00' + cast(s_suppkey % 25 as int) * interval '1' day end valid_until,
        case when s_suppkey % 7 = 0 then timestamp '2024-01-14 00:00:00' end compromised_from from supplier""",
    # what the sendings of submissions say of themselves; faults are of an event, so that all its sendings share them
    "claims": """select submission_id, sent, tenant_id, stream_id, sequence, source_time, wire_digest content, n,
        concat('0190a000-0000-7000-8', case substr(record_id, 1, 1) when 'e' then '000' when 'z' then '001' else '002' end, '-', lpad(substr(record_id, 2), 12, '0')) record_id,
        case when n % 31 = 0 then 'RevocationRecord' else 'AgentIdentity' end record_type, n % 27 = 5 bad_time, (sequence = 1) <> (n % 53 = 1) first_of_stream, concat('col', cast(c as string)) collector_id,
        case when n % 17 = 0 then 'old' else cast(c % 3 as string) end collector_version, case when n % 5 = 0 then 'sdk' when n % 47 = 3 then 'other' end implementation, case when n % 59 <> 2 then concat('ck', cast(case when n % 23 = 7 then c + 3 else c end as string)) end key_id, n % 211 <> 0 sig_ok
        from (select *, 3 * (n % (select count(*) div 3 + 1 from supplier)) + cast(substr(tenant_id, 2) as bigint) c from (select *, cast(substr(record_id, 2) as bigint) n from submissions) p) q""",
    # every fifth population gives a digest in place of its identifiers
    "digest_populations": """select *, case when cast(substr(population_ref, 4) as bigint) % 5 = 0 then 'sha256:0' end identifier_digest from populations""",
    # connectors as they describe themselves; some contradict themselves
    "connectors": """select s_suppkey connector, s_suppkey % 3 <> 0 enumeration, s_suppkey % 4 <> 0 confirmation, s_suppkey % 5 <> 0 authoritative_time, case when s_suppkey % 11 = 0 then -1 when s_suppkey % 3 <> 0 or s_suppkey % 2 = 0 then 60 end settlement_lag_s,
        case when (s_suppkey % 3 = 0) <> (s_suppkey % 7 = 0) then 'enumeration_unavailable' else 'enumerated' end attribution_surface,
        case when s_suppkey % 17 = 0 then 'shared_with_enumeration' when (s_suppkey % 4 <> 0) <> (s_suppkey % 13 = 0) then 'own' else 'not_available' end confirmation_access from supplier""",
    # streams with the statements that came with their records, where one did; most are right
    "rotation_keys": """select distinct tenant_id, key_id, concat('pk-', key_id) public_key from keys""",
    "rotations": """select r.tenant_id, r.stream_id, r.sequence, r.record_id, r.key_id, (p.key_id <> r.key_id and r.event_id % 10 <> 0) or (p.key_id = r.key_id and r.event_id % 37 = 0) or (r.sequence = 1 and r.event_id % 3 = 0) said,
        case when r.event_id % 11 = 1 then 'k999' else coalesce(p.key_id, r.key_id) end c_predecessor_key_id, case when r.event_id % 13 = 2 then 'k998' else r.key_id end c_new_key_id, case when r.event_id % 17 = 3 then 'other' else r.tenant_id end c_tenant_id,
        case when r.event_id % 23 = 4 then null else r.stream_id end c_stream_id, case when r.event_id % 43 = 5 then 'rsa' else 'ed25519' end c_alg, case when r.event_id % 7 = 6 then 'pk-x' else concat('pk-', r.key_id) end c_new_public_key, r.event_id % 41 = 4 c_extra, r.event_id % 19 <> 6 c_sig_ok
        from stream_records r left join stream_records p on p.tenant_id = r.tenant_id and p.stream_id = r.stream_id and p.sequence = r.sequence - 1""",
    "cadences": """select qualification_ref, timestamp '1995-01-31 10:00:00' + cast(k % 700 as int) * interval '1' day qualified_at, case k % 19 when 0 then concat('P', cast(k % 5 as string), 'Y') when 1 then concat('P', cast(k % 13 as string), 'M') when 2 then concat('P', cast(k % 4 as string), 'W')
        when 3 then concat('P', cast(k as string), 'D') when 4 then concat('PT', cast(k as string), 'H') when 5 then concat('P1DT2H30M', cast(k % 60 as string), '.5S') when 6 then concat('P1Y2M3DT4H5M6.', cast(k + 1000000 as string), '9S') when 7 then 'P1W1D' when 8 then 'PT' when 9 then 'P1DT' when 10 then 'P-1D'
        when 11 then 'P' when 12 then '' when 13 then null when 14 then 'P1.5M' when 15 then '1H' when 16 then 'PT1,25S' when 17 then 'P2M1Y' when 18 then concat('P', cast(k % 3 as string), 'Y', cast(k % 14 as string), 'M', cast(k % 2 as string), 'D') end cadence
        from (select qualification_ref, cast(substr(qualification_ref, 2) as bigint) k from qualifications) q""",
    # instants a nanosecond apart, with offsets, leap seconds and impossible dates
    "instant_texts": """select k, case k % 9 when 0 then '1996-03-01T00:00:00.000000001Z' when 1 then '1996-03-01T00:00:00.000000002Z' when 2 then '1996-03-01T00:00:00.000Z' when 3 then '1996-02-29T23:59:60.000Z' when 4 then '1996-03-01T05:30:00.000000001+05:30'
        when 5 then '1996-02-29T18:00:00.000000002-06:00' when 6 then '1997-02-29T00:00:00.000Z' when 7 then '1996-03-01T00:00:00.0000000011Z' when 8 then '1996-03-01 00:00:00Z' end a, case k % 7 when 0 then '1996-03-01T00:00:00.000000001Z' when 1 then '1996-03-01T00:00:00.000000002Z'
        when 2 then '1996-03-01T00:00:00.000000000Z' when 3 then '9999-12-31T23:59:59.999999999Z' when 4 then '1996-03-01T00:00:60.0000Z' when 5 then '1996-03-01T24:00:00.000Z' when 6 then '1996-03-01T00:00:00.000+24:00' end b
        from (select cast(s_suppkey as bigint) k from supplier) q""",
    "scoped_gaps": """select cast(gap_id as string) bundle_id, gap_id, gap_start, gap_end, cause, gap_id % 4 kind, concat(chr(123), '"families":["f', cast(gap_id % 3 as string), '","g"],"tenant":"', tenant_id, '"', chr(125)) signed_scope from gaps""",
    # in some windows the boundary came late, ended early, or was never in force
    "boundary_windows": """select tenant_id, population_ref, population_ref boundary_ref, window_start, window_end, case when signed_count % 4 = 0 then window_start + interval '2' day else window_start end effective_start,
        case when signed_count % 7 = 0 then window_end - interval '1' day else window_end end effective_end, signed_count % 11 = 0 empty from populations""",
    "declared_boundaries": """select *, case when version % 4 = 1 then 'crm' else 'crm,erp' end destinations, concat('q', cast(version % 3 as string), case when version % 2 = 0 then ',q9' else '' end) refs from boundaries""",
    "declared_families": """select *, concat('q', cast(case when action_family = 'family.7' then 5 else version % 3 end as string)) qualification_ref from boundary_families""",
    # the records of streams dealt into bundles; some out of order, some without an attestation or with two
    "bundle_items": """select bundle_id, type record_type, concat('w', lpad(cast(n as string), 9, '0')) wire, case when bundle % 5 = 0 and pos = 2 then 1 when bundle % 5 = 0 and pos = 1 then 2 else pos end pos from (
        select bundle, concat('b', cast(bundle as string)) bundle_id, event_id n, cast(row_number() over (partition by bundle order by event_id) as int) pos,
        case when event_id % 10 = 0 and bundle % 7 <> 0 then 'AttestationWindow' when bundle % 11 = 0 and event_id % 10 = 1 then 'AttestationWindow' when event_id % 10 = 2 or (bundle % 3 = 0 and event_id % 10 = 3) then 'AssuranceBoundary' else 'ActionProposal' end type
        from (select event_id, event_id div 10 bundle from events) e) q""",
    # what came back for the populations' requests, some of it wrong
    "responses": """select population_ref request_id, case when n % 3 = 0 then 'other' else action_family end action_family, destination_system, case when n % 5 = 0 then window_end else window_start end window_start, window_end,
        case when n % 7 = 0 then 'x' else boundary_ref end echoed_parameters, window_start echoed_start, window_end echoed_end, n as count, case when n % 4 = 0 then n + 1 else n end n_identifiers, case when n % 9 <> 0 then ts_min end ts_min, ts_max,
        case when n % 8 = 0 then window_end else ts_max end authoritative_time, result_cap_hit, pagination_complete, cast(case when n % 6 = 1 then 3600001 else 5 end as bigint) observed_lag_ms from (select *, signed_count n from populations) p where n % 23 <> 0""",
    "scoped_boundaries": """select tenant_id, population_ref boundary_ref, window_start, case when signed_count % 5 = 0 then window_start else window_end end window_end from populations where signed_count % 7 <> 0""",
    "scoped_qualifications": """select population_ref boundary_ref, case when signed_count % 3 = 0 and v = 1 then 'other' else tenant_id end tenant_id, case when signed_count % 4 = 0 and v = 1 then 'other' else action_family end action_family,
        case when signed_count % 13 = 0 and v = 1 then 'other' else destination_system end destination_system from populations, (select distinct r_regionkey v from region where r_regionkey in (1, 2)) r where signed_count % 11 <> 0""",
    "carried_boundaries": """select attestation_id bundle_id, concat('rec-', attestation_id) record_id, case when signed_count % 7 = 0 then 'elsewhere' else a.boundary_ref end boundary_ref, 'q' ref1, case when signed_count % 3 = 0 then 'q' else concat('q', cast(signed_count as string)) end ref2
        from attestations a join (select population_ref, signed_count from populations) p on p.population_ref = a.population_ref where signed_count % 5 <> 0""",
    "carried_qualifications": """select attestation_id bundle_id, case when v = 1 then concat('q', cast(signed_count as string)) else 'q' end record_id from attestations a join (select population_ref, signed_count from populations) p on p.population_ref = a.population_ref, (select distinct r_regionkey v from region where r_regionkey in (1, 2)) r""",
    "observed_populations": """select population_ref, window_end eligible_at, s source_time, case when n % 3 = 0 then window_end else s end retrieved_at, case when n % 6 = 5 then s - interval '1' minute else s end observed_at
        from (select *, signed_count n, case when signed_count % 4 = 0 then window_end - interval '1' hour else window_end + interval '1' hour end s from populations) p""",
    "bound_boundaries": """select tenant_id, population_ref boundary_ref, window_start, case when signed_count % 7 = 0 then window_end - interval '1' day else window_end end window_end from populations where signed_count % 10 <> 0""",
    "bound_families": """select population_ref boundary_ref, action_family, destination_system from populations where signed_count % 3 <> 0""",
    "family_records": """select concat('t', cast(o_custkey % 4 as string)) tenant_id, concat('f', substr(o_orderpriority, 1, 1)) action_family, o_orderdate authoritative_time, cast(o_orderkey as bigint) record_no from orders""",
    "family_lags": """select concat('f', cast(r_regionkey + 1 as string)) action_family, cast(r_regionkey * r_regionkey * 8 * 86400 + 3600 as bigint) lag_s from region""",
    "page_log": """select o_custkey query_id, cast(row_number() over (partition by o_custkey order by o_orderkey) as int) page_no, case when o_orderkey % 97 = 0 then 11 else 10 end total_size,
        cast(1 + o_orderkey % 3 as bigint) n_records, o_orderkey % 101 = 0 failed,
        case when lead(o_orderkey) over (partition by o_custkey order by o_orderkey) is null then null when o_orderkey % 89 = 0 then 'page-again' else concat('page-', cast(o_orderkey as string)) end next_url from orders""",
    "refusals": """select concat('t', cast(user_id % 3 as string)) tenant_id, concat('col', cast(user_id % 40 as string)) collector_id, event_id, ts refused_at,
        event_type = 'purchase' restored, event_id % 4 <> 0 fail_open from events where event_type in ('purchase', 'error')""",
}


def dependencies(name: str) -> list[str]:
    """The views that a view reads, each before those that read it, itself last."""
    out: list[str] = []

    def visit(view: str) -> None:
        for other in VIEWS:
            if other != view and other not in out and re.search(rf"\b{other}\b", VIEWS[view].split("select", 1)[1]) and re.search(rf"(from|join|,)\s+{other}\b", VIEWS[view]):
                visit(other)
        if view not in out:
            out.append(view)

    visit(name)
    return out


def _inputs(spark: SparkSession, sf_dir: str, sql: str) -> dict[str, DataFrame]:
    return {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in TABLES if re.search(rf"\b{t}\b", sql)}


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    chain = dependencies(name)
    ctes = ", ".join(f"{v} as ({VIEWS[v]})" for v in chain)
    sql = f"with {ctes} select * from {name}"
    inputs = _inputs(spark, sf_dir, sql)
    for t in inputs:
        sql = re.sub(rf"\b(from|join)\s+{t}\b(?!\s+as \()", rf"\1 {{{t}}} {t}" if not re.search(rf"\b(from|join)\s+{t}\s+[a-z]\b(?!\w)", sql) else rf"\1 {{{t}}}", sql)
    df = spark.sql(sql, **inputs)
    plain = [c for c, t in df.dtypes if t == "timestamp_ntz"]
    return df.withColumns({c: df[c].cast("timestamp") for c in plain}) if plain else df


def duck(sql: str) -> str:
    """The same text for DuckDB."""
    sql = re.sub(r"sha2\((.*?), 256\)", lambda m: f"sha256({m[1]})", sql, flags=re.S)
    sql = re.sub(r"\bas string\)", "as varchar)", sql)
    sql = re.sub(r"date_format\((\w+), 'yyyyMMdd'\)", r"strftime(\1, '%Y%m%d')", sql)
    return re.sub(r"\bdiv\b", "//", sql)


def oracle(sql: str, *names: str) -> str:
    """A query over views as one DuckDB statement."""
    if not names:
        return duck(sql)
    chain: list[str] = []
    for n in names:
        chain += [v for v in dependencies(n) if v not in chain]
    return duck("with " + ", ".join(f"{v} as ({VIEWS[v]})" for v in chain)) + (", " + sql.strip()[5:] if sql.strip().startswith("with ") else " " + sql)
