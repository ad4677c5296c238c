"""Queries of whole contracts: gates, selections, bindings, publication, receipts, with their oracle SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import exprs as x
from ..operators import evaluation as ev
from ..operators import feedback as fb
from ..operators import identity as idt
from ..operators import library
from ..operators import proposal as pr
from ..operators import publication as pb
from ..operators import receipts as rc
from ..operators import retrieval as rt
from ..operators import selection as sel
from ..sources import io
from ..sources.proxies import INVENTORY_SQL, inventory, table
from .catalog import HOLD_SQL, MATCH_SQL, query, retrieved

SOURCE = {"identifier": "documents", "expected_count": 1, "identifier_sha256": "0" * 64}


def policy(quotas: dict[str, int], **more):
    views = [{"id": v, "label": f"View {v}", "quota": q} for v, q in quotas.items()]
    return {"seed": 17, "target_count": sum(quotas.values()), "unclassified_view": "en", "evaluation_sample_per_view": 5, "source": SOURCE, "views": views} | more


# evaluation

GATES = policy({"de": 5, "en": 5, "es": 5, "fr": 5, "it": 5, "pt": 0}, minimum_view_eval_sample=60, minimum_eval_coverage=0.4, minimum_eval_precision=0.5, minimum_view_eval_precision=0.55)
GATES["views"][1] |= {"minimum_eval_precision": 0.9}
GATES["views"][2] |= {"evaluation_mode": ev.SPARSE}


def feedback(spark, d):
    rows, n = inventory(spark, d), F.col("uuid").cast("long")
    said = F.when(n % 13 == 0, " Uncertain ").when(n % 17 == 0, "unsure").otherwise(F.col("judgment"))
    return rows.withColumns({"judgment": said, "visible_reason": F.when(n % 11 == 0, " ").otherwise(F.col("source")), "view_selected_count": F.when((n % 3 == 0) | (F.col("primary_view") == "fr"), "").otherwise((n % 50).cast("string"))})


FEEDBACK_SQL = (
    INVENTORY_SQL
    + """, feedback as (
  select * replace (case when uuid::bigint % 13 = 0 then 'uncertain' when uuid::bigint % 17 = 0 then 'unsure' else judgment end as judgment),
    case when uuid::bigint % 11 = 0 then '' else source end as visible_reason, case when uuid::bigint % 3 = 0 or primary_view = 'fr' then 0 else uuid::bigint % 50 end as view_selected_count from inv
), views(view, mode, quota, gate) as (values ('de', 'material', 5, 0.55), ('en', 'material', 5, 0.9), ('es', 'sparse-hypothesis', 5, 0.55), ('fr', 'material', 5, 0.55), ('it', 'material', 5, 0.55)),
said as (
  select primary_view as view, count(*) as sampled, count(*) filter (where judgment in ('fit', 'reject', 'uncertain')) as judged, count(*) filter (where judgment = 'fit') as fit,
    count(*) filter (where judgment = 'reject') as reject, count(*) filter (where judgment = 'uncertain') as uncertain, max(view_selected_count) as largest from feedback group by 1
), rates as (
  select v.view, mode, gate, coalesce(sampled, 0) as sampled, coalesce(judged, 0) as judged, coalesce(fit, 0) as fit, coalesce(reject, 0) as reject, coalesce(fit + reject, 0) as decisive,
    coalesce(judged::double / sampled, 0) as coverage, coalesce(uncertain::double / nullif(judged, 0), 0) as uncertainty, fit::double / nullif(fit + reject, 0) as precision, least(60, coalesce(largest, quota)) as required_decisive
  from views v left join said s on v.view = s.view
), gates as (
  select *, array_to_string(list_filter([case when sampled = 0 then 'view not sampled' end, case when coverage < 0.4 then 'coverage below minimum' end, case when uncertainty > 0.25 then 'uncertainty above maximum' end,
    case when mode = 'material' and decisive < required_decisive then 'insufficient decisive judgments' end, case when mode = 'material' and (precision is null or precision < gate) then 'precision below minimum' end], lambda v: v is not null), ';') as reasons from rates
)
"""
)


@query(FEEDBACK_SQL + "select view, mode as evaluation_mode, sampled, judged, fit, reject, decisive, required_decisive::bigint as required_decisive, reasons as failure_reasons, reasons = '' as passed from gates")
def q_eval_gate(spark, d):
    rows = ev.view_gates(feedback(spark, d), GATES)
    return rows.select("view", "evaluation_mode", "sampled", "judged", "fit", "reject", "decisive", "required_decisive", F.array_join("failure_reasons", ";").alias("failure_reasons"), "passed")


@query(FEEDBACK_SQL + f""", whole as (
  select count(*) as sampled, count(*) filter (where judgment in ('fit', 'reject', 'uncertain')) as judged, count(*) filter (where judgment = 'fit') as fit, count(*) filter (where judgment = 'reject') as reject,
    count(*) filter (where judgment in ('fit', 'reject', 'uncertain') and visible_reason = '') as missing_reasons, count(*) filter (where {HOLD_SQL}) as safety_blocks from feedback)
select *, (select count(*) from gates where reasons <> '') as failed_views, judged >= 0.4 * sampled and fit >= 0.5 * (fit + reject) and missing_reasons = 0 and safety_blocks = 0 and not exists (select 1 from gates where reasons <> '') as passed from whole""")
def q_eval_global(spark, d):
    return ev.global_gate(feedback(spark, d), GATES).select("sampled", "judged", "fit", "reject", "missing_reasons", "safety_blocks", "failed_views", "passed")


# holds, reasons, whole selections


@query(
    INVENTORY_SQL.replace("with inv", "with recursive inv")
    + f""", edges as (
  select uuid, 'duplicate:' || duplicate_group as g from inv where duplicate_group <> '' union select uuid, 'burst:' || burst_group from inv
), closure as (
  select uuid from inv where {HOLD_SQL} union select e2.uuid from closure c join edges e1 on c.uuid = e1.uuid join edges e2 on e1.g = e2.g
)
select uuid, case when uuid in (select uuid from closure) and not {HOLD_SQL} then 'automatic-hold' else safety_status end as safety_status,
  case when uuid in (select uuid from closure) and not {HOLD_SQL} then case when uuid::bigint % 4 = 0 then 'seen; ' else '' end || '{pr.RELATED}' when uuid::bigint % 4 = 0 then 'seen' else '' end as safety_reason from inv
"""
)
def q_related_holds(spark, d):
    rows = inventory(spark, d).withColumn("safety_reason", F.when(F.col("uuid").cast("long") % 4 == 0, "seen").otherwise(""))
    return pr.with_related_holds(rows).select("uuid", "safety_status", "safety_reason")


@query(INVENTORY_SQL + """select uuid, 'editorial assignment ' || primary_view || '; retrieval hypotheses: ' || primary_view || ';' || source || case when source <> '' then '; visible observation: ' || source else '' end ||
  '; evidence confidence: ' || evidence_confidence || case when persons <> '' then '; pre-existing named people' else '' end || case when favorite or edited then '; prior favorite/edit attention' else '' end as selection_reason,
  case when evidence_confidence in ('high', 'medium') then 'evidence' else 'exploratory' end as selection_tier from inv""")
def q_selection_reason(spark, d):
    rows = inventory(spark, d).withColumn("candidate_views", F.concat_ws(";", "primary_view", "source"))
    return rows.select("uuid", pr.reason(rows, F.col("primary_view")).alias("selection_reason"), x.selection_tier(F.col("evidence_confidence")).alias("selection_tier"))


PICK = policy({"de": 3, "en": 5, "es": 2, "fr": 3})
PICK_SHA = idt.policy_digest(PICK)


def explicit(spark, d):
    return inventory(spark, d).withColumn("assigned_view", F.col("primary_view"))


PICK_SQL = (
    INVENTORY_SQL.replace("with inv", "with recursive inv")
    + f""", edges as (
  select uuid, 'duplicate:' || duplicate_group as g from inv where duplicate_group <> '' union select uuid, 'burst:' || burst_group from inv
), closure as (
  select uuid from inv where {HOLD_SQL} union select e2.uuid from closure c join edges e1 on c.uuid = e1.uuid join edges e2 on e1.g = e2.g
), free as (select * from scored where uuid not in (select uuid from closure)), dups as (
  select *, row_number() over (partition by duplicate_group order by (favorite and edited) desc, favorite desc, edited desc, aesthetic_score desc, noise desc, uuid desc) as rd from free
), bursts as (
  select *, row_number() over (partition by burst_group order by (favorite and edited) desc, favorite desc, edited desc, aesthetic_score desc, noise desc, uuid) as rb from dups where duplicate_group = '' or rd = 1
), pool as (select * from bursts where burst_group = '' or rb <= 2), quotas(v, q) as (values ('de', 3), ('en', 5), ('es', 2), ('fr', 3)), master as (
  select p.*, row_number() over (partition by primary_view order by score_total::double desc, uuid) as n from pool p join quotas on v = primary_view qualify n <= q
), digest as (
  select sha256('[' || string_agg('{{"assigned_view":"' || primary_view || '","config_sha256":"{PICK_SHA}","uuid":"' || uuid || '"}}', ',' order by primary_view, uuid) || ']') as sha from master
)
"""
)


@query(PICK_SQL + f"select uuid, primary_view, score_total, '{PICK_SHA}' as config_sha256, (select sha from digest) as master_sha256, 'pfp-' || (select sha from digest)[1:16] as proposal_id, 'retrieval-only' as provenance_status, 'publication-review-required' as publication_state from master")
def q_select_full(spark, d):
    return pr.select(explicit(spark, d), PICK)[0].select("uuid", "primary_view", "score_total", "config_sha256", "master_sha256", "proposal_id", "provenance_status", "publication_state")


@query(PICK_SQL + """select (select count(*) from master) as selected_count, (select count(*) from master where persons <> '') as named_people_count, (select count(*) from master where evidence_confidence in ('low', 'unknown', '')) as uncertain_count,
  (select sha from digest) as master_sha256, (select count(*) from inv) as inventory_count, (select count(*) from pool) as eligible_count, (select count(*) from closure) as hold_count, 'explicit-assigned-view' as assignment_method, '{"' || (select string_agg(primary_view || '":' || n, ',"' order by primary_view) from (select primary_view, count(*) as n from master group by 1)) || '}' as view_counts,
  '""" + PICK_SHA + """' as config_sha256""")
def q_select_summary(spark, d):
    return pr.select(explicit(spark, d), PICK)[2].drop("proposal_id")


def master(spark, d):
    """A bound master of every row that is not held, for queries that only need one."""
    rows = inventory(spark, d)
    return idt.bound(rows.filter(~sel.is_hold(rows)).withColumns({"assigned_view": F.col("primary_view"), "selection_reason": F.lit("chosen")}), PICK)


MASTER_SQL = (
    INVENTORY_SQL
    + f""", master as (select * from scored where not {HOLD_SQL}), digest as (
  select sha256('[' || string_agg('{{"assigned_view":"' || primary_view || '","config_sha256":"{PICK_SHA}","uuid":"' || uuid || '"}}', ',' order by primary_view, uuid) || ']') as sha from master
)
"""
)


def tampered(spark, d):
    """The master after it was bound: rows twice, reasons and views lost, held rows, another policy, no id."""
    rows, n = master(spark, d), F.col("uuid").cast("long")
    rows = rows.unionByName(rows.filter(n % 17 == 0))
    worse = {"selection_reason": F.when(n % 7 == 0, "").otherwise(F.col("selection_reason")), "assigned_view": F.when(n % 19 == 0, "").otherwise(F.col("assigned_view")), "safety_status": F.when(n % 11 == 0, " HOLD").otherwise(F.col("safety_status"))}
    return rows.withColumns(worse | {"config_sha256": F.when(n % 13 == 0, "x").otherwise(F.col("config_sha256")), "uuid": F.when(n % 23 == 0, " ").otherwise(F.col("uuid"))})


TAMPERED_SQL = (
    MASTER_SQL
    + """, bad as (select primary_view, uuid::bigint as n, case when uuid::bigint % 23 = 0 then '' else uuid end as id from (select * from master union all select * from master where uuid::bigint % 17 = 0)),
identity as (select count(*) filter (where id = '') as blank, count(*) - count(distinct id) as repeated, count(*) as whole from bad)
"""
)


@query(TAMPERED_SQL + """select 'blank ids' as "check", blank as failures from identity union all select 'repeated ids', repeated from identity union all select 'master digest differs', whole from identity
union all select 'proposal id differs', whole from identity union all select 'no rows', 0""")
def q_bound_master(spark, d):
    return idt.identity_errors(tampered(spark, d)).withColumn("failures", F.col("failures").cast("long"))


@query(TAMPERED_SQL + """, views as (select coalesce(v, primary_view) as v, q, c from (values ('de', 3), ('en', 5), ('es', 2), ('fr', 3)) w(v, q) full join (select primary_view, count(*) as c from bad group by 1) on v = primary_view)
select 'blank ids' as "check", blank as failures from identity union all select 'repeated ids', repeated from identity union all select 'master digest differs', whole from identity
union all select 'proposal id differs', whole from identity union all select 'no rows', 0 union all select 'rows off target', abs(whole - 13) from identity union all select 'held rows selected', count(*) from bad where n % 11 = 0
union all select 'selection reason missing', count(*) from bad where n % 7 = 0 union all select 'assigned view missing', count(*) from bad where n % 19 = 0 union all select 'policy digest differs', count(*) from bad where n % 13 = 0
union all select 'overlap with holds', count(distinct id) from bad where n % 5 = 0 and n % 23 <> 0 union all select 'views absent', count(*) from views where c is null union all select 'views off quota', count(*) from views where coalesce(c, 0) <> coalesce(q, 0)""")
def q_validate_full(spark, d):
    return pr.validate(tampered(spark, d), inventory(spark, d).filter(F.col("uuid").try_cast("long") % 5 == 0), PICK)


@query(MASTER_SQL + """, placed as (select 'master' as key, '00 MASTER - ' as title, primary_view, uuid, score_total from master union all select 'view-' || primary_view, primary_view || ' View ' || primary_view || ' - ', primary_view, uuid, score_total from master)
select key, title || format('{:,}', count(*)) as title, count(*) as n, string_agg(uuid, ',' order by primary_view, score_total::double desc, uuid) as asset_ids from placed group by key, title""")
def q_albums(spark, d):
    rows = master(spark, d)
    return pr.albums(sel.scored(rows), PICK).withColumn("asset_ids", F.array_join("asset_ids", ","))


@query(MASTER_SQL + """select (select sha from digest) as master, (select sha256('[' || string_agg('{"burst_group":"' || burst_group || '","duplicate_group":"' || duplicate_group || '","duplicate_group_id":"","hidden":"","missing":"","perceptual_cluster_id":"","safety_reason":"","safety_status":"hold","uuid":"' || uuid || '"}', ',' order by uuid) || ']')
  from inv where safety_status = 'hold') as safety""")
def q_identity_digests(spark, d):
    rows = inventory(spark, d)
    return idt.master_digest(master(spark, d)).select(F.col("digest").alias("master")).crossJoin(idt.safety_digest(rows.filter(sel.is_hold(rows))).select(F.col("digest").alias("safety")))


# feedback


@query(MASTER_SQL + """, ranked as (select uuid, row_number() over (partition by primary_view order by score_total::double, uuid) - 1 as pos, count(*) over (partition by primary_view) as size from master), drawn as (select uuid from ranked where pos in (0, size // 2, size - 1))
select uuid, array_to_string(list_filter([case when uuid::bigint % 2 = 0 then 'view differs' end, case when uuid::bigint % 3 = 0 then 'master_sha256 differs' end, case when uuid::bigint % 5 = 0 then 'inspection digest differs' end], lambda v: v is not null), ';') as errors
from drawn where uuid::bigint % 2 = 0 or uuid::bigint % 3 = 0 or uuid::bigint % 5 = 0 union all select 'nobody', 'outside the exact master'""")
def q_feedback_binding(spark, d):
    rows = sel.scored(master(spark, d))
    rule, n = PICK | {"evaluation_sample_per_view": 3}, F.col("uuid").cast("long")
    rows = idt.bound(rows, rule)
    drawn = fb.review_sample(rows, 3, rule["seed"])
    filled = drawn.withColumns({"inspection_path": F.concat(F.lit("/p/"), "uuid"), "inspection_sha256": F.when(n % 5 == 0, "bad").otherwise(F.sha2("uuid", 256)), "inspection_round_id": F.col("round_id"), "inspection_sample_sha256": F.col("sample_sha256")})
    filled = filled.withColumns({"primary_view": F.when(n % 2 == 0, "xx").otherwise(F.col("primary_view")), "master_sha256": F.when(n % 3 == 0, "").otherwise(F.col("master_sha256"))})
    stray = filled.limit(1).withColumns({"uuid": F.lit("nobody"), "master_sha256": F.lit(None).cast("string")}).drop("master_sha256").crossJoin(idt.master_digest(rows).select(F.col("digest").alias("master_sha256")))
    stray = stray.withColumn("inspection_sha256", F.sha2("uuid", 256))
    return fb.feedback_errors(filled.unionByName(stray), rows, rule).withColumn("errors", F.array_join("errors", ";"))


@query(INVENTORY_SQL + """select uuid, array_to_string(list_filter([case when uuid::bigint % 10 = 0 then 'no preview' end, case when safety_status = 'hold' then 'blocked safety state' end, case when uuid::bigint % 10 <> 0 and uuid::bigint % 6 = 0 then 'preview does not decode' end,
  case when uuid::bigint % 10 <> 0 and uuid::bigint % 7 = 0 then 'preview digest differs' end], lambda v: v is not null), ';') as errors from inv where uuid::bigint % 10 = 0 or safety_status = 'hold' or uuid::bigint % 6 = 0 or uuid::bigint % 7 = 0""")
def q_review_errors(spark, d):
    return fb.review_records(*previews(spark, d))[1].withColumn("errors", F.array_join("errors", ";"))


def previews(spark, d):
    rows, n = inventory(spark, d), F.col("uuid").cast("long")
    index = rows.filter(n % 10 != 0).select(F.concat("uuid", F.lit("/L0/001")).alias("uuid"), F.concat(F.lit("/p/"), "uuid", F.lit(".JPG")).alias("preview_path"), F.sha2("uuid", 256).alias("preview_sha256"), F.when(n % 6 == 0, "invalid").otherwise("ok").alias("decode_status"), F.when(n % 7 == 0, "").otherwise(F.sha2("uuid", 256)).alias("found_sha256"))
    return rows, index


@query(INVENTORY_SQL + "select uuid, primary_view, sha256(uuid)[1:24] || '.jpg' as image, sha256(uuid) as inspection_sha256 from inv where not (uuid::bigint % 10 = 0 or safety_status = 'hold' or uuid::bigint % 6 = 0 or uuid::bigint % 7 = 0)")
def q_review_records(spark, d):
    return fb.review_records(*previews(spark, d))[0].select("uuid", "primary_view", "image", "inspection_sha256")


# publication


@query(MASTER_SQL + "select uuid, filename, primary_view, (select sha from digest) as master_sha256, 'not-reviewed' as publication_status, 'human-needs-review' as safety_status, '' as caption from master")
def q_clearance_scaffold(spark, d):
    return pb.scaffold(master(spark, d)).select("uuid", "filename", "primary_view", "master_sha256", "publication_status", "safety_status", "caption")


def ledger(spark, d, faults: bool):
    """Clearance of the whole master: two in three are cleared; with faults, some of these cannot be."""
    rows, n = pb.scaffold(master(spark, d)), F.col("uuid").cast("long")
    bad = lambda k, wrong, right: F.when(F.lit(faults) & (n % k == 0), wrong).otherwise(right)
    return rows.withColumns({
        "publication_status": F.when(n % 3 == 0, "not-reviewed").otherwise("Published "), "rights_status": bad(5, "unknown", "licensed"), "consent_status": F.lit("not-applicable"), "claim_status": F.lit("visible-only"),
        "safety_status": F.lit("clear"), "caption": bad(7, "=cmd", "A caption"), "alt_text": F.lit("Alt"), "credit": bad(8, " ", "Ada"), "crop": F.lit("1:1"), "public_destination": F.lit("site"),
        "reviewer_actor": F.lit("Bo"), "reviewer_lens": F.lit("human-review"), "review_date": bad(11, "2026-1-2", "2026-01-02"), "master_sha256": bad(13, "x", F.col("master_sha256")),
    })


SALT = b"0123456789abcdef"
PAD = SALT.ljust(64, b"\0")
ERROR_SQL = """array_to_string(list_filter([case when n % 13 = 0 then 'master identity' end, case when n % 5 = 0 then 'rights clearance' end, case when n % 8 = 0 then 'credit' end,
  case when n % 7 = 0 then 'caption begins with a spreadsheet formula marker' end, case when n % 11 = 0 then 'ISO review date' end], lambda v: v is not null), ';')"""


@query(MASTER_SQL + f"select uuid, {ERROR_SQL} as errors from (select uuid, uuid::bigint as n from master) where n % 3 <> 0 and (n % 13 = 0 or n % 5 = 0 or n % 8 = 0 or n % 7 = 0 or n % 11 = 0)")
def q_handoff_errors(spark, d):
    return pb.handoff(master(spark, d), ledger(spark, d, True), SALT, "site")[1].withColumn("errors", F.array_join("errors", ";"))


@query(MASTER_SQL + f"""select case when count(*) filter (where {ERROR_SQL} <> '') = 0 then count(*) else 0 end as public_rows, count(*) filter (where {ERROR_SQL} <> '') as error_rows, count(*) as clearing_rows
from (select uuid::bigint as n from master where uuid::bigint % 3 <> 0)""")
def q_handoff_closed(spark, d):
    """All or nothing: some clearing rows have errors, so none of the others is published."""
    rows = ledger(spark, d, True)
    public, errors = pb.handoff(master(spark, d), rows, SALT, "site")
    clearing = rows.agg(F.count_if(pb.state(rows, "publication_status").isin(*pb.CLEARING)).alias("clearing_rows"))
    return public.agg(F.count("*").alias("public_rows")).crossJoin(errors.agg(F.count("*").alias("error_rows"))).crossJoin(clearing)  # rows of one each


@query(MASTER_SQL + """select substr(sha256(from_hex('{}') || from_hex(sha256(from_hex('{}') || encode('site' || chr(31) || uuid)))), 1, 24) as public_id, primary_view, 'licensed' as rights_status,
  sha256(concat_ws(chr(31), uuid, 'pfp-' || (select sha from digest)[1:16], (select sha from digest), 'Published', 'licensed', 'not-applicable', 'visible-only', 'clear', 'A caption', 'Alt', 'Ada', '1:1', '', '', 'site', 'Bo', 'human-review', '2026-01-02')) as publication_decision_id
from master where uuid::bigint % 3 <> 0""".format(bytes(b ^ 0x5C for b in PAD).hex(), bytes(b ^ 0x36 for b in PAD).hex()))
def q_handoff_open(spark, d):
    return pb.handoff(master(spark, d), ledger(spark, d, False), SALT, "site")[0].select("public_id", "primary_view", "publication_decision_id", "rights_status")


@query(MASTER_SQL + """select primary_view, '' as page_slot, 'published' as publication_status, 'licensed' as rights_status, 'not-applicable' as consent_status, 'visible-only' as claim_status, 'Alt' as alt_text, 'A caption' as caption, 'Ada' as credit,
  '1:1' as crop, '' as focal_point, 'site' as public_destination, '2026-01-02' as review_date, length(uuid) * 0 + 24 as id_length from master where uuid::bigint % 3 <> 0""")
def q_public_projection(spark, d):
    """All public fields of a ledger without errors; ids and decisions are in q_handoff_open."""
    public, _ = pb.handoff(master(spark, d), ledger(spark, d, False), SALT, "site")
    return public.withColumn("id_length", F.length("public_id").cast("long")).drop("public_id", "publication_decision_id")


FIELDS_JSON_SQL = """'{"assigned_view":"","error_category":"","evaluation_note":"","hidden":"","inspection_path":"","inspection_round_id":"","inspection_sample_sha256":"","inspection_sha256":"","judgment":"' ||
  case when n % 13 = 0 then ' Uncertain ' when n % 17 = 0 then 'unsure' else judgment end || '","master_sha256":"","missing":"","primary_view":"' || primary_view || '","proposal_id":"","reviewer_actor":"","reviewer_lens":"","round_id":"r1","safety_status":"' ||
  safety_status || '","sample_sha256":"S","uuid":"' || uuid || '","view_selected_count":"' || case when n % 3 = 0 or primary_view = 'fr' then '' else (n % 50)::varchar end || '","visible_reason":"' || case when n % 11 = 0 then ' ' else source end || '"}'"""


@query(MASTER_SQL + f"""select 'pfp-' || (select sha from digest)[1:16] as proposal_id, (select sha from digest) as master_sha256, sha256('[' || string_agg({FIELDS_JSON_SQL}, ',' order by uuid) || ']') as feedback_sha256, 'S' as sample_sha256,
  '{idt.policy_digest(GATES)}' as config_sha256 from (select *, uuid::bigint as n from inv)""")
def q_report_digests(spark, d):
    return ev.bindings(feedback(spark, d).withColumns({"round_id": F.lit("r1"), "sample_sha256": F.lit("S")}), GATES, master(spark, d))


# retrieval


@query(MATCH_SQL + """, parts as (select p_partkey::varchar as uuid, case when p_size % 7 = 0 and p_size % 5 = 0 then 12 when p_size % 7 = 0 then 7 when p_size % 5 = 0 then 5 else 0 end as attention from part),
noisy as (select s.*, attention, ('0x' || substr(sha256('47:' || view || ':' || uuid), 1, 16))::ubigint::double / 18446744073709551616.0 as noise from scores s join parts using (uuid)),
ranked as (select *, row_number() over (partition by view order by score + attention desc, noise desc, uuid desc) as rank from noisy),
took as (select *, row_number() over (partition by uuid order by view desc, rank) as n from ranked where rank <= case view when 'warm' then 18 else 53 end)
select view, uuid, score, attention::int as attention, rank::int as rank from took where n = 1""")
def q_retrieval_take(spark, d):
    assets = table(spark, d, "part").select(F.col("p_partkey").cast("string").alias("uuid"), (F.col("p_size") % 7 == 0).alias("favorite"), (F.col("p_size") % 5 == 0).alias("edited"))
    return rt.view_take(retrieved(spark, d), assets, {"warm": 10, "cool": 30}, 1.75, 47).select("view", "uuid", "score", F.col("attention").cast("int").alias("attention"), F.col("rank").cast("int").alias("rank"))


@query(MATCH_SQL + "select view, count(distinct uuid) as available from scores group by view")
def q_availability(spark, d):
    return rt.availability(retrieved(spark, d))


@query("""select p_partkey, array_to_string(list_filter(string_split(p_name, ' '), lambda v: not contains(lower(v), 'red') and not contains(lower(v), 'ol')), ' ') as kept from part""")
def q_excluded_titles(spark, d):
    return table(spark, d, "part").select("p_partkey", F.array_join(rt.without_titles(F.split("p_name", " "), ["Red", "OL", "red", " "]), " ").alias("kept"))


# receipts, sources, rows


@query("""with plan as (select 'n' || n_nationkey as key, n_name as title, 'r' || n_regionkey as parent from nation union all select 'r' || r_regionkey, r_name, null from region), got as (
  select key, case when key = 'n3' then 'other' else title end as title, case when key = 'n5' then 'id-r0' when parent is not null then 'id-' || parent end as parent_id from plan where key <> 'n7' union all select 'extra', 'x', null)
select coalesce(p.key, g.key) as key, case when g.key is null then 'missing' when p.key is null then 'unexpected' when p.title <> g.title then 'title differs' else 'parent differs' end as reason
from plan p full join got g on p.key = g.key where g.key is null or p.key is null or p.title <> g.title or ('id-' || p.parent) is distinct from g.parent_id""")
def q_folder_differences(spark, d):
    nation, region = table(spark, d, "nation"), table(spark, d, "region")
    plan = nation.select(F.concat(F.lit("n"), "n_nationkey").alias("key"), F.col("n_name").alias("title"), F.concat(F.lit("r"), "n_regionkey").alias("parent_key")).unionByName(region.select(F.concat(F.lit("r"), "r_regionkey").alias("key"), F.col("r_name").alias("title"), F.lit(None).cast("string").alias("parent_key")))
    parent = F.when(F.col("key") == "n5", "id-r0").when(F.col("parent_key").isNotNull(), F.concat(F.lit("id-"), "parent_key"))
    got = plan.filter("key <> 'n7'").select("key", F.when(F.col("key") == "n3", "other").otherwise(F.col("title")).alias("title"), F.concat(F.lit("id-"), "key").alias("identifier"), parent.alias("parent_identifier"))
    got = got.unionByName(spark.createDataFrame([("extra", "x", "id-extra", None)], got.schema))
    return rc.folder_differences(plan, got)


@query("""with plan as (select 's' || l_suppkey as title, count(distinct l_partkey) as n, 'r' || l_suppkey % 5 as parent from lineitem group by l_suppkey)
select title, case when l % 9 = 0 then 'missing' when l % 7 = 0 then 'count differs' else 'parent differs' end as reason from (select *, title[2:]::bigint as l from plan) where l % 9 = 0 or l % 7 = 0 or l % 5 = 4 union all select 'extra', 'unexpected'""")
def q_album_differences(spark, d):
    key, region = F.col("l_suppkey"), table(spark, d, "region")
    plan = table(spark, d, "lineitem").select(F.concat(F.lit("s"), key).alias("title"), F.concat(F.lit("r"), key % 5).alias("parent_folder_key"), F.col("l_partkey").alias("asset_id"))
    folders = region.select(F.concat(F.lit("r"), "r_regionkey").alias("key"), F.concat(F.lit("id-"), "r_regionkey").alias("identifier"))
    got = table(spark, d, "lineitem").filter(key % 9 != 0).groupBy(key).agg((F.count_distinct("l_partkey") + F.when(key % 7 == 0, 1).otherwise(0)).alias("count"))
    got = got.select(F.concat(F.lit("s"), key).alias("title"), "count", F.when(key % 5 == 4, "id-0").otherwise(F.concat(F.lit("id-"), key % 5)).alias("parent_identifier"))
    return rc.album_differences(plan, got.unionByName(spark.createDataFrame([("extra", 1, None)], got.schema)), folders)


@query("select 'album' as kind, 'u1' as identifier, 'view' as expected_title, count(*)::bigint as expected_count, sha256(string_agg(u || chr(10), '' order by u)) as identifier_sha256 from (select distinct user_id::varchar as u from events where event_type = 'view')")
def q_frozen_source(spark, d):
    events = table(spark, d, "events").select(F.col("user_id").cast("string").alias("uuid"), F.col("event_type").alias("title"))
    assets = events.select("uuid", F.lit(True).alias("is_photo"), F.lit(False).alias("hidden"), F.lit(False).alias("trashed"))
    return rc.frozen_source(rt.members(assets, events, "view"), "u1", "view")


@query("""with asked as (select o_orderkey as k from orders where o_orderkey % 3 <> 0), got as (select o_orderkey as k, 1 + (o_orderkey % 11 = 0)::int as n from orders where o_orderkey % 4 <> 0)
select coalesce(a.k, g.k)::varchar as uuid, case when g.k is null then 'missing' when a.k is null then 'not asked for' else 'repeated' end as reason from asked a full join got g on a.k = g.k where g.k is null or a.k is null or n > 1""")
def q_reconciled(spark, d):
    orders, key = table(spark, d, "orders"), F.col("o_orderkey")
    asked = orders.filter(key % 3 != 0).select(F.concat(key, F.lit("/L0/001")).alias("uuid"), key.alias("position"))
    got = orders.filter(key % 4 != 0).select(key.cast("string").alias("uuid"), F.explode(F.sequence(F.lit(1), F.when(key % 11 == 0, 2).otherwise(1))).alias("copy"))
    return rc.reconciled(asked, got)[1]


@query("select user_id, event_type, event_id from (select *, row_number() over (partition by user_id, event_type order by ts desc, event_id) as n from events) where n = 1")
def q_first_rows(spark, d):
    rows = table(spark, d, "events").select("user_id", "event_type", "event_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("at"))
    return io.first_rows(rows, ["user_id", "event_type"], [-F.col("at"), F.col("event_id")]).select("user_id", "event_type", "event_id")


@query("select 'n' || n_nationkey as uuid, n_name as filename, '' as note from nation union all select 'r' || r_regionkey, '', r_name from region")
def q_union_manifests(spark, d):
    one = table(spark, d, "nation").select(F.concat(F.lit("n"), "n_nationkey").alias("uuid"), F.col("n_name").alias("filename"))
    return io.union_manifests(one, table(spark, d, "region").select(F.concat(F.lit("r"), "r_regionkey").alias("uuid"), F.col("r_name").alias("note")))


@query("""select o_orderkey, strftime(t, '%Y-%m-%d %H:%M:%S') as captured, year(t)::int as year, month(t)::int as month, lower(o_orderstatus || ' ' || o_orderkey) as words, replace(o_orderkey || '/L0/001', '/', '_') || '.jpg' as preview
from (select *, make_timestamp((o_orderkey * 5000 + 978307200)::bigint * 1000000) as t from orders)""")
def q_capture_parts(spark, d):
    captured, year, month = x.apple_parts(F.col("o_orderkey") * 5000)
    return table(spark, d, "orders").select("o_orderkey", captured.alias("captured"), year.alias("year"), month.alias("month"), x.search_text(F.col("o_orderstatus"), F.col("o_orderkey")).alias("words"), x.preview_name(F.concat("o_orderkey", F.lit("/L0/001"))).alias("preview"))


@query("""select doc_id, array_to_string(list_filter([case when doc_id % 7 >= 3 then lang end, case when doc_id % 5 >= 3 then source end], lambda v: v is not null), ';') as labels,
  greatest(1, floor(n_chars * least(1.0::double, 640 / greatest(n_chars, doc_id, 1)::double)))::bigint as width, greatest(1, floor(doc_id * least(1.0::double, 640 / greatest(n_chars, doc_id, 1)::double)))::bigint as height from documents""")
def q_inspection_parts(spark, d):
    sure = x.confident_labels(F.array("lang", "source"), F.array(F.col("doc_id") % 7 / 60.0, F.col("doc_id") % 5 / 60.0), 0.05)
    width, height = x.fitted_size(F.col("n_chars"), F.col("doc_id"), 640)
    return table(spark, d, "documents").select("doc_id", F.array_join(sure, ";").alias("labels"), width.cast("long").alias("width"), height.cast("long").alias("height"))


@query("""select count(*)::bigint as inspected, count(*) filter (where toxic = 0)::bigint as cleared, count(*) filter (where toxic = 1)::bigint as held, count(*) filter (where toxic is null)::bigint as unavailable,
  count(*) filter (where doc_id % 2 = 0)::bigint as exported, count(*) filter (where doc_id % 10 = 0)::bigint as failed from documents left join labels using (doc_id)""")
def q_inspection_totals(spark, d):
    rows = table(spark, d, "documents").select("doc_id").join(table(spark, d, "labels"), "doc_id", "left")
    flags = F.when(F.col("toxic") == 1, F.array(F.lit("toxic"))).otherwise(F.array().cast("array<string>"))
    state = F.when(F.col("toxic").isNull(), "unavailable").otherwise(x.safety_state(flags))
    return rc.inspection_totals(rows.select(state.alias("safety_state"), (F.col("doc_id") % 2 == 0).alias("preview_exported"), F.when(F.col("doc_id") % 10 == 0, "failed").alias("error")))


# catalogs and plans


@query("""with faces as (select l_orderkey as k, count(*) as n from lineitem where l_linenumber % 3 <> 0 group by 1)
select o_orderkey as pk, strftime(make_timestamp((o_orderkey + 978307200)::bigint * 1000000), '%Y-%m-%d %H:%M:%S') as date_created, o_orderkey % 7 = 0 as favorite, o_orderkey % 5 = 0 or c_custkey % 2 = 0 as edited, coalesce(c_mktsegment, '') <> '' as external_edit,
  n_name as description, (o_orderkey & 64) <> 0 as portrait, coalesce(n, 0) as face_count, c_name as title, o_orderkey % 4 = 0 as burst
from orders left join customer on c_custkey = o_custkey left join nation on n_nationkey = c_nationkey left join faces on k = o_orderkey where o_orderkey % 11 <> 0 and o_orderkey % 13 <> 0""")
def q_catalog_assets(spark, d):
    key, none = F.col("o_orderkey"), lambda t, *names: [F.lit(None).cast(t).alias(n) for n in names]
    base = table(spark, d, "orders").select(
        key.alias("pk"), key.cast("string").alias("uuid"), *[key.alias(c) for c in ("created", "added", "modified", "width", "height", "kind_subtype")], F.lit(0).alias("kind"), (key % 13 == 0).cast("int").alias("trashed"), (key % 11 == 0).cast("int").alias("hidden"),
        (key % 7 == 0).cast("int").alias("favorite"), (key % 5 == 0).cast("int").alias("adjustments"), F.lit("g").alias("cloud_guid"), F.lit(0).alias("screenshot"), (key % 4 == 0).cast("int").alias("burst_kind"),
        *none("string", "filename", "burst_key", "media_group"), *none("double", "burst_pick", "overall_aesthetic_score", "curation_score", "promotion_score", "highlight_score", "latitude", "longitude"), "o_custkey",
    )
    who = table(spark, d, "customer")
    attributes = base.select(F.col("pk").alias("asset"), "o_custkey").join(who, F.col("o_custkey") == F.col("c_custkey")).select(
        "asset", F.col("c_nationkey").alias("description"), F.when(F.col("c_custkey") % 2 == 0, 1).alias("unmanaged_adjustment"), F.col("c_mktsegment").alias("editor"), F.col("c_name").alias("title"), *none("string", "original_filename"), *none("long", "original_width", "original_height", "original_size")
    )
    descriptions = table(spark, d, "nation").select(F.col("n_nationkey").alias("pk"), F.col("n_name").alias("text"))
    computed = base.limit(0).select(F.col("pk").alias("asset"), *none("double", "failure_score", "composition_score", "focus_score", "subject_score", "framing_score", "timing_score"))
    extended = base.limit(0).select(F.col("pk").alias("asset"), *none("string", "camera_make", "camera_model"))
    faces = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("asset"), (F.col("l_linenumber") % 3 == 0).cast("int").alias("hidden"), F.lit(0).alias("trashed"))
    rows = library.assets(base.drop("o_custkey"), attributes, descriptions, computed, extended, faces)
    return rows.select("pk", "date_created", "favorite", "edited", "external_edit", "description", "portrait", "face_count", "title", "burst")


@query(INVENTORY_SQL + """, rows as (select uuid, uuid::bigint as position, primary_view, persons, evidence_confidence from inv), tested as (select * from rows order by (evidence_confidence = 'high') desc, position limit 10)
select 'master' as album, position, uuid from rows union all select 'view-' || primary_view, position, uuid from rows union all select 'named-people', position, uuid from rows where persons <> ''
union all select 'uncertain', position, uuid from rows where evidence_confidence in ('unknown', 'low') union all select 'write-test', position, uuid from tested""")
def q_snapshot_members(spark, d):
    return library.snapshot_members(inventory(spark, d).withColumn("position", F.col("uuid").cast("long")))


@query("select user_id || '/L0/001' as asset_identifier, min(event_id) as position from events group by user_id order by position limit 50")
def q_inspection_members(spark, d):
    rows = table(spark, d, "events").select(F.col("user_id").cast("string").alias("uuid"), F.col("event_id").alias("position"))
    return library.inspection_members(rows, "position", 50)


@query("""with required as (select distinct s_nationkey as capability, 's' || s_suppkey % 4 as provider from supplier), rows as (select *, provider in ('s1', 's2') as there from required)
select capability, case when bool_and(there) then 'AVAILABLE' when bool_or(there) then 'DEGRADED' else 'UNAVAILABLE' end as state, coalesce(string_agg(provider, ',' order by provider) filter (where not there), '') as missing from rows group by capability""")
def q_capability_states(spark, d):
    required = table(spark, d, "supplier").select(F.col("s_nationkey").alias("capability"), F.concat(F.lit("s"), F.col("s_suppkey") % 4).alias("provider"))
    available = spark.createDataFrame([("s1",), ("s2",), ("s9",)], "provider string")
    return library.capability_states(required, available).withColumn("missing", F.array_join("missing", ","))
