"""The recommender's stages as DuckDB SQL: named parts, and a query that takes along the parts it mentions."""

from __future__ import annotations

import re

NOW = "timestamp '2024-01-31 00:00:00'"
AGE = f"(date_diff('microsecond', created_at, {NOW}) / 86400000000.0::double)"
BUCKET = "case when estimated_hours <= 2 then 'UNDER_2_HOURS' when estimated_hours <= 5 then 'ONE_EVENING' when estimated_hours <= 20 then 'WEEKEND' else 'ONE_TO_TWO_WEEKS' end"


def _clamp(x: str, low: str = "0", high: str = "1") -> str:
    return f"least({high}::double, greatest({low}::double, {x}))"


PARTS = {
    "interactions": """select *, case type when 'IMPRESSION' then 0.0 when 'OPEN' then 0.5 when 'SAVE' then 2.0 when 'UNSAVE' then -1.0 when 'DISLIKE' then -3.0
  when 'BUILD' then 4.0 when 'COMPLETE' then 5.0 when 'SHARE' then 3.0 end::double as weight from (
  select event_id as id, user_id, json_extract(props, '$.k')::bigint as project_id, ts as created_at,
    case event_type when 'view' then if(event_id % 2 = 0, 'IMPRESSION', 'OPEN') when 'click' then if(event_id % 5 = 0, 'UNSAVE', 'SAVE')
      when 'signup' then 'SHARE' when 'purchase' then if(event_id % 2 = 0, 'BUILD', 'COMPLETE') when 'error' then 'DISLIKE' end as type from events)""",
    "catalog": """select p_partkey as project_id, lpad(p_partkey::varchar, 6, '0') as slug, p_name as title, list_distinct(string_split(p_name, ' ')) as tag_slugs,
  [lower(p_brand)] as language_slugs, case when p_type like 'ECONOMY%' or p_type like 'SMALL%' then 'BEGINNER' when p_type like 'MEDIUM%' or p_type like 'STANDARD%' then 'INTERMEDIATE' else 'ADVANCED' end as difficulty,
  p_size as estimated_hours, (p_partkey * 37 % 101) / 100.0::double as prior from part where p_partkey in (select project_id from interactions)""",
    "app_users": "select distinct user_id, (user_id % 21) / 20.0::double as e from interactions",
    "features": f"""select project_id, 'tag:' || unnest(tag_slugs) as feature, 1.0::double as value from catalog
  union all select project_id, 'lang:' || unnest(language_slugs), 0.5::double / len(language_slugs) from catalog
  union all select project_id, 'difficulty:' || difficulty, 0.35::double from catalog
  union all select project_id, 'duration:' || {BUCKET}, 0.35::double from catalog""",
    "norms": "select project_id, sqrt(sum(value * value)) as norm from features group by project_id",
    "states": """select user_id, project_id,
  coalesce(arg_max(type, row(created_at, id)) filter (where type in ('SAVE', 'UNSAVE', 'DISLIKE')) = 'SAVE', false) as saved,
  coalesce(arg_max(type, row(created_at, id)) filter (where type in ('SAVE', 'DISLIKE')) = 'DISLIKE', false) as disliked,
  bool_or(type = 'BUILD') as built, bool_or(type = 'COMPLETE') as completed, bool_or(type = 'OPEN') as opened, bool_or(type = 'SHARE') as shared,
  bool_or(type in ('DISLIKE', 'BUILD', 'COMPLETE')) as excluded, count(*) as interaction_count, min(created_at) as first_touch,
  max(created_at) filter (where type = 'SAVE') as last_save from interactions group by user_id, project_id""",
    "gone": "select user_id, project_id from states where excluded",
    "gaps": """select *, coalesce(date_diff('microsecond', lag(created_at) over (partition by user_id order by created_at, id), created_at) > 21600000000, true)::int as starts from interactions""",
    "sessionized": "select *, (sum(starts) over (partition by user_id order by created_at, id rows unbounded preceding))::bigint as session_no from gaps",
    "all_sessions": "select user_id, session_no, min(created_at) as started_at, max(created_at) as last_active_at, count(*) as n_events from sessionized group by user_id, session_no",
    "active": f"""select *, last_active_at + interval 360 minute as expires_at from (select * from all_sessions qualify row_number() over (partition by user_id order by session_no desc) = 1)
  where date_diff('microsecond', last_active_at, {NOW}) <= 21600000000""",
    "history": "select * from sessionized anti join active using (user_id, session_no)",
    "session_rows": "select * from sessionized semi join active using (user_id, session_no)",
    "tags": "select tag, row_number() over (order by tag) - 1 as tag_no from (select distinct unnest(tag_slugs) as tag from catalog)",
    "numbered": "select *, row_number() over (order by project_id) - 1 as item_no from catalog",
    "answers": """select user_id, u.difficulty as difficulty, u.duration as duration, c.project_id as chosen, r.project_id as rejected from (select user_id,
    (user_id * 3) % (select count(*) from catalog) as c, (user_id * 3 + 1) % (select count(*) from catalog) as r,
    case user_id % 4 when 0 then 'BEGINNER' when 1 then 'INTERMEDIATE' when 2 then 'ADVANCED' end as difficulty,
    case user_id % 5 when 0 then 'UNDER_2_HOURS' when 1 then 'ONE_EVENING' when 2 then 'WEEKEND' when 3 then 'ONE_TO_TWO_WEEKS' else 'ANYTHING' end as duration from app_users) u
  join numbered c on c.item_no = u.c join numbered r on r.item_no = u.r""",
    "picked_topics": "select distinct user_id, tag from (select user_id, (user_id * 7 + unnest([0, 5, 10])) % (select count(*) from tags) as tag_no from app_users) join tags using (tag_no)",
    "topic_tags": "select tag as topic, tag, 1.0::double as weight from tags union all select t.tag, n.tag, 0.5::double from tags t join tags n on n.tag_no = (t.tag_no + 1) % (select count(*) from tags)",
    "onboarding": """select user_id, feature, sum(signal) as signal from (
  select user_id, 'tag:' || w.tag as feature, 2.0::double * weight as signal from picked_topics p join topic_tags w on w.topic = p.tag
  union all select user_id, feature, 1.5::double * value from answers join features on project_id = chosen
  union all select user_id, feature, -0.5::double * value from answers join features on project_id = rejected
  union all select user_id, 'difficulty:' || difficulty, 1.0::double from answers where difficulty is not null
  union all select user_id, 'duration:' || duration, 1.0::double from answers where duration <> 'ANYTHING') group by user_id, feature""",
    "long_signals": f"""select user_id, feature, sum(signal) as signal from (
  select user_id, feature, sum(scale * value) as signal from (select user_id, project_id, sum(weight * case when {AGE} <= 0 then 1 else pow(0.5, {AGE} / 30) end) as scale
    from history where weight <> 0 and {AGE} <= 365 group by user_id, project_id) join features using (project_id) group by user_id, feature
  union all select * from onboarding) group by user_id, feature""",
    "long_term": """select user_id, feature, signal, signal / sqrt(sum(signal * signal) over (partition by user_id)) as vector, signal / max(abs(signal)) over (partition by user_id) as strength
  from long_signals where abs(signal) > 1e-12""",
    "session_profile": """select user_id, feature, signal, signal / sqrt(sum(signal * signal) over (partition by user_id)) as vector, signal / max(abs(signal)) over (partition by user_id) as strength
  from (select user_id, feature, sum(weight * value) as signal from session_rows join features using (project_id) where weight <> 0 group by user_id, feature) where abs(signal) > 1e-12""",
    "evidence": """select user_id, count(*) as meaningful, (select sum(abs(w)) from (select distinct project_id, type, weight as w from session_rows x where x.user_id = s.user_id and weight <> 0)) as evidence
  from session_rows s where weight <> 0 group by user_id""",
    "coherence": """select user_id, coalesce(sum(a) filter (where r <= 3) / nullif(sum(a), 0), 0) as coherence from (
  select user_id, abs(signal) as a, row_number() over (partition by user_id order by abs(signal) desc, feature) as r from session_profile where feature like 'tag:%') group by user_id""",
    "confidence": f"""select *, 0.45 * {_clamp('confidence')} as blend_weight from (select *, evidence_confidence * (0.5 + 0.5 * coherence) as confidence from (
  select user_id, meaningful, evidence, coalesce(coherence, 0.0) as coherence, case when evidence > 0 then evidence / (evidence + 4) else 0 end as evidence_confidence
  from evidence left join coherence using (user_id)))""",
    "effective": """select user_id, feature, raw / sqrt(sum(raw * raw) over (partition by user_id)) as vector from (
  select user_id, feature, (1 - w) * coalesce(l, 0) + w * coalesce(s, 0) as raw from (
    select user_id, feature, l.vector as l, s.vector as s,
      case when user_id not in (select user_id from session_profile) then 0 when user_id not in (select user_id from long_term) then 1 else coalesce(least(0.45, greatest(0, blend_weight)), 0) end as w
    from long_term l full join session_profile s using (user_id, feature) left join confidence using (user_id)))
  where abs(raw) > 1e-12""",
    "popularity_evidence": """select project_id, sum(weight * n) as evidence from (select project_id, type, weight, count(*) as n from interactions
  where type in ('OPEN', 'SAVE', 'BUILD', 'COMPLETE', 'SHARE') group by all) group by project_id""",
    "popularity": f"""select project_id, slug, prior, behaviour, round({_clamp('0.4 * least(1, greatest(0, prior)) + 0.6 * behaviour')}, 9) as popularity from (
  select *, coalesce({_clamp('raw / nullif(max(raw) over (), 0)')}, 0) as behaviour from (
    select project_id, slug, prior, ln(1 + greatest(0, coalesce(evidence, 0))) as raw from catalog left join popularity_evidence using (project_id)))""",
    "popular": """select user_id, project_id, popularity, row_number() over (partition by user_id order by popularity desc, slug) as rank
  from app_users cross join popularity anti join gone using (user_id, project_id) qualify rank <= 15""",
    "affinities": f"""select user_id, project_id, round({_clamp('coalesce(dot / nullif(norm, 0), 0)', '-1')}, 9) as affinity from (
  select user_id, project_id, sum(vector * value) as dot from effective join features using (feature) group by user_id, project_id) join norms using (project_id)""",
    "content": """select user_id, project_id, affinity, row_number() over (partition by user_id order by affinity desc, prior desc, slug) as rank
  from affinities join catalog using (project_id) anti join gone using (user_id, project_id) where affinity >= 0.01 qualify rank <= 50""",
    "signals": """select * from (select user_id, project_id, case when disliked then 0 else (case when completed then 5 when built then 4 else 0 end) + if(saved, 2, 0) + if(shared, 3, 0) + if(opened, 0.5, 0) end::double as signal,
  case when completed then 'completed' when built then 'built' when saved then 'saved' when shared then 'shared' when opened then 'opened' end as state from states) where signal > 0""",
    "item_norms": "select project_id, sum(signal * signal) as n from signals group by project_id",
    "pairs": """select i, j, dot, overlap, x.n as ni, y.n as nj from (select a.project_id as i, b.project_id as j, sum(a.signal * b.signal) as dot, count(*) as overlap
  from signals a join signals b on a.user_id = b.user_id and a.project_id <> b.project_id group by all) join item_norms x on x.project_id = i join item_norms y on y.project_id = j""",
    "similarities": f"select i, j, overlap, round({_clamp('dot / (sqrt(ni) * sqrt(nj)) * overlap / (overlap + 2.0)')}, 8) as similarity from pairs where similarity > 0",
    "neighbours": "select i, j, similarity, row_number() over (partition by i order by similarity desc, j) as rank from similarities qualify rank <= 20",
    "left_out_pairs": """select t.user_id as target, a.project_id as i, b.project_id as j, sum(a.signal * b.signal) as dot, count(*) as overlap
  from app_users t join signals a on a.user_id <> t.user_id join signals b on a.user_id = b.user_id and a.project_id <> b.project_id
  where exists (select 1 from signals s where s.user_id = t.user_id and s.project_id = a.project_id) group by all""",
    "left_out_norms": "select t.user_id as target, project_id, sum(signal * signal) as n from app_users t join signals s on s.user_id <> t.user_id group by all",
    "left_out_neighbours": f"""select target as user_id, i, j, similarity from (
  select target, i, j, round({_clamp('dot / (sqrt(x.n) * sqrt(y.n)) * overlap / (overlap + 2.0)')}, 8) as similarity from left_out_pairs
  join left_out_norms x using (target) join left_out_norms y using (target) where x.project_id = i and y.project_id = j)
  where similarity > 0 qualify row_number() over (partition by target, i order by similarity desc, j) <= 20""",
    "supports": """select n.user_id, n.j as project_id, n.i as seed_id, similarity * s.signal as part from left_out_neighbours n join signals s on s.user_id = n.user_id and s.project_id = n.i
  where not exists (select 1 from signals o where o.user_id = n.user_id and o.project_id = n.j) and not exists (select 1 from gone g where g.user_id = n.user_id and g.project_id = n.j)""",
    "collaborative_scores": f"""select user_id, project_id, evidence, collaborative, support from (
  select *, round({_clamp('evidence / max(evidence) over (partition by user_id) * confidence')}, 9) as collaborative from (
    select user_id, project_id, round(sum(part), 9) as evidence, list(seed_id order by round(part, 9) desc, seed_id)[1:3] as support from supports group by user_id, project_id)
  join (select user_id, least(1, sum(signal) / 6) as confidence from signals group by user_id) using (user_id)) where collaborative >= 0.02""",
    "collaborative": """select user_id, project_id, collaborative, row_number() over (partition by user_id order by collaborative desc, slug) as rank
  from collaborative_scores join catalog using (project_id) qualify rank <= 30""",
    "session_affinity": f"""select user_id, project_id, affinity as raw, greatest(0, affinity) as score from (
  select user_id, project_id, round({_clamp('dot / norm', '-1')}, 9) as affinity from (select user_id, project_id, sum(vector * value) as dot from session_profile semi join confidence using (user_id) join features using (feature) group by user_id, project_id)
  join norms using (project_id))""",
    "item_frame": f"""select *, round(0.65 * (1 - {_clamp('popularity')}) + 0.35 * 4 * {_clamp('coalesce(affinity, 0)')} * (1 - {_clamp('coalesce(affinity, 0)')}), 9) as novelty from (
  select u.user_id, u.e, c.project_id, c.slug, c.prior, p.popularity, case when u.user_id in (select user_id from affinities) then coalesce(a.affinity, 0) end as affinity, s.collaborative
  from (select user_id, project_id from affinities union select user_id, project_id from collaborative_scores union select user_id, project_id from popular
    union select user_id, project_id from app_users cross join catalog where user_id not in (select user_id from affinities)) k join app_users u on u.user_id = k.user_id join catalog c on c.project_id = k.project_id join popularity p on p.project_id = c.project_id left join affinities a on a.user_id = u.user_id and a.project_id = c.project_id
  left join collaborative_scores s on s.user_id = u.user_id and s.project_id = c.project_id)""",
    "exploration": f"""select user_id, project_id, exploration, plausibility, row_number() over (partition by user_id order by exploration desc, prior desc, slug) as rank from (
  select *, round({_clamp('(1 - e) * plausibility + e * (0.65 * novelty + 0.35 * plausibility)')}, 9) as exploration from (
    select *, case when affinity is null and collaborative is null then {_clamp('popularity')} else {_clamp('greatest(0, coalesce(affinity, 0), coalesce(collaborative, 0))')} end as plausibility from item_frame anti join gone using (user_id, project_id))
  where plausibility >= 0.05) qualify rank <= floor(8 + 7 * e + 0.5)""",
    "candidates": """select user_id, project_id, 0 as place, 'content' as source, affinity as signal from content
  union all select user_id, project_id, 1, 'collaborative', collaborative from collaborative
  union all select user_id, project_id, 2, 'popular', popularity from popular
  union all select user_id, project_id, 3, 'exploration', exploration from exploration""",
    "merged": "select user_id, project_id, array_to_string(list(source order by place), ',') as sources, max(signal) as best_signal, count(*) as n_sources from candidates group by user_id, project_id",
    "raw_weights": f"""select user_id, e, cold_start, confidence, has_profile, has_collaborative, has_session,
  case when has_profile then greatest(0, 0.45 - 0.15 * e) end as rc, case when has_collaborative then greatest(0, 0.25 - 0.05 * e) end as rb,
  case when has_session then 0.1 * {_clamp('coalesce(confidence, 0)')} end as rs, greatest(0, 0.05 + 0.3 * e) as rn, 0.1 * if(cold_start, 3.0, 1.0) as rp from (
  select user_id, e, coalesce(n, 0) < 3 as cold_start, confidence, user_id in (select user_id from effective) as has_profile, user_id in (select user_id from collaborative_scores) as has_collaborative,
    user_id in (select user_id from session_profile semi join confidence using (user_id)) as has_session
  from app_users left join (select user_id, count(*) as n from interactions where type <> 'IMPRESSION' group by user_id) using (user_id) left join confidence using (user_id))""",
    "weights": """select user_id, e, cold_start, confidence, has_profile, has_collaborative, has_session, round(rc / t, 9) as w_content, round(rb / t, 9) as w_collaborative,
  round(rs / t, 9) as w_session, round(rn / t, 9) as w_novelty, round(rp / t, 9) as w_popularity from (select *, coalesce(rc, 0) + coalesce(rb, 0) + coalesce(rs, 0) + coalesce(rn, 0) + coalesce(rp, 0) as t from raw_weights)""",
    "inputs": """select m.user_id, m.project_id, m.sources, f.slug, f.prior, f.popularity, f.affinity as content, f.collaborative, f.novelty, w.* exclude (user_id),
  case when w.has_session then coalesce(s.score, 0) end as session, coalesce(st.saved, false) as saved
  from merged m join item_frame f using (user_id, project_id) join weights w on w.user_id = m.user_id left join session_affinity s on s.user_id = m.user_id and s.project_id = m.project_id
  left join states st on st.user_id = m.user_id and st.project_id = m.project_id where not exists (select 1 from gone g where g.user_id = m.user_id and g.project_id = m.project_id)""",
    "ranked": f"""select *, row_number() over (partition by user_id order by score desc, prior desc, slug) as rank from (select *, round({_clamp('''
  coalesce(w_content * least(1, greatest(-1, content)), 0) + coalesce(w_collaborative * least(1, greatest(0, collaborative)), 0) + coalesce(w_session * least(1, greatest(0, session)), 0)
  + coalesce(w_novelty * least(1, greatest(0, novelty)), 0) + coalesce(w_popularity * least(1, greatest(0, popularity)), 0)''')} * if(saved, 0.6, 1.0), 9) as score from inputs)""",
}


#: Parts that evaluation cases are made of.
EARLY = ("interactions", "catalog", "features", "norms", "gaps", "sessionized")


def sql(query: str, extra: dict[str, str] | None = None, late: dict[str, str] | None = None) -> str:
    """query behind a WITH of all parts that it and they mention, in order; extra parts follow the others, or EARLY if they replace some, and late ones come last."""
    extra = extra or {}
    if set(extra) & set(PARTS):
        parts = {n: PARTS[n] for n in EARLY} | {n: t for n, t in extra.items() if n not in PARTS} | {n: extra.get(n, t) for n, t in PARTS.items() if n not in EARLY}
    else:
        parts = PARTS | extra
    parts = parts | (late or {})
    wanted, todo = [], [query]
    while todo:
        text = todo.pop()
        for name in parts:
            if name not in wanted and re.search(rf"\b{name}\b", text):
                wanted.append(name)
                todo.append(parts[name])
    order = [n for n in parts if n in wanted]
    word = "with recursive " if any("--recursive" in parts[n] for n in wanted) else "with "
    return (word + ",\n".join(f"{n} as ({parts[n]})" for n in order) + "\n" if order else "") + query


def diversified(ranked: str, limit: int = 10) -> dict[str, str]:
    """Parts that pick from ``ranked`` one item of each user at a time: rows of ``picks`` have final_rank."""
    return {
        "cosines": """select a.project_id as a, b.project_id as b, round(least(1, greatest(0, sum(a.value * b.value) / (any_value(x.norm) * any_value(y.norm)))), 9) as c
  from features a join features b on a.feature = b.feature join norms x on x.project_id = a.project_id join norms y on y.project_id = b.project_id group by all""",
        "mmr_walk": f"""--recursive
  select user_id, r.project_id, score, rank as pre_rank, least(0.95, greatest(0.5, 0.9 - 0.2 * e))::double as lam, greatest(2, floor((0.45 - 0.15 * e) * {limit} + 0.5)) as cap, tag_slugs as tags,
    list_transform(tag_slugs, lambda t: 0) as used, 0.0::double as nearest, count(*) over (partition by user_id) >= 3 as applied, 0 as step, null::int as final_rank, 0.0::double as mmr, 0.0::double as max_similarity, false as relaxed
  from {ranked} r join catalog using (project_id)
  union all
  select t.user_id, t.project_id, score, pre_rank, lam, cap, tags, list_transform(tags, lambda x, i: used[i] + list_contains(best_tags, x)::int), greatest(nearest, coalesce(c, 0)), applied, step + 1,
    if(pick = 1, step + 1, null)::int, if(applied, value, round(lam * score, 12)), if(applied, nearest, 0.0), applied and not open
  from (select *, first_value(project_id) over (partition by user_id order by pick) as best, first_value(tags) over (partition by user_id order by pick) as best_tags from (
    select *, row_number() over (partition by user_id order by case when applied and (allowed or not open) then value end desc nulls last, pre_rank) as pick from (
      select *, bool_or(allowed and value is not null) over (partition by user_id) as open from (
        select *, case when score >= 0.8 * max(score) over (partition by user_id) then round(lam * score - (1 - lam) * nearest, 12) end as value,
          nearest < 0.9 and len(list_filter(used, lambda u: u >= cap)) = 0 as allowed from mmr_walk where final_rank is null and step < {limit})))) t
  left join cosines on a = t.project_id and b = best""",
        "picks": "select * from mmr_walk where final_rank is not null",
    }


def at_cutoff(with_session: bool) -> dict[str, str]:
    """The parts that differ where each case is scored at its own cutoff, beside those of the cases themselves."""
    clamp = _clamp
    return {
        "case_log": "select s.*, cutoff from sessionized s join cases using (user_id) where created_at < cutoff",
        "app_users": "select user_id, (user_id % 21) / 20.0::double as e from cases",
        "active": "select user_id, arg_min(session_no, id) as session_no from sessionized join cases using (user_id) where created_at = cutoff and list_contains(held_out, project_id) group by user_id" if with_session else "select user_id, session_no from sessionized where false",
        "history": "select * from case_log anti join active using (user_id, session_no)",
        "session_rows": "select * from case_log semi join active using (user_id, session_no)",
        "long_signals": """select user_id, feature, sum(scale * value) as signal from (select user_id, project_id, sum(weight * case when age <= 0 then 1 else pow(0.5, age / 30) end) as scale
  from (select *, date_diff('microsecond', created_at, cutoff) / 86400000000.0::double as age from history where weight <> 0) where age <= 365 group by user_id, project_id) join features using (project_id) group by user_id, feature""",
        "gone": "select user_id, project_id from out_of_case",
        "states": PARTS["states"].replace("from interactions", "from case_log"),
        "popularity": f"""select user_id, project_id, slug, prior, round({clamp('0.4 * least(1, greatest(0, prior)) + 0.6 * behaviour')}, 9) as popularity from (
  select *, coalesce({clamp('raw / nullif(max(raw) over (partition by user_id), 0)')}, 0) as behaviour from (select *, ln(1 + greatest(0, evidence)) as raw from all_items))""",
        "popular": "select user_id, project_id, popularity, row_number() over (partition by user_id order by popularity desc, slug) as rank from popularity anti join gone using (user_id, project_id) qualify rank <= 15",
        "collaborative_scores": "select user_id, project_id, evidence, score as collaborative from case_scored where score >= 0.02",
        "item_frame": f"""select *, round(0.65 * (1 - {clamp('popularity')}) + 0.35 * 4 * {clamp('coalesce(affinity, 0)')} * (1 - {clamp('coalesce(affinity, 0)')}), 9) as novelty from (
  select p.user_id, u.e, p.project_id, p.slug, p.prior, p.popularity, case when p.user_id in (select user_id from affinities) then coalesce(a.affinity, 0) end as affinity, s.collaborative
  from popularity p join app_users u on u.user_id = p.user_id left join affinities a on a.user_id = p.user_id and a.project_id = p.project_id left join collaborative_scores s on s.user_id = p.user_id and s.project_id = p.project_id)""",
        "raw_weights": PARTS["raw_weights"].replace("from interactions where", "from case_log where"),
    }


def explained() -> dict[str, str]:
    """Parts that say why each of ``picks`` is shown: rows of ``reasons`` have primary, text and factors."""
    prose = lambda x: f"array_to_string(list_transform(string_split({x}, ' '), lambda w: if(regexp_matches(w, '^[A-Z][a-z]+$'), lower(w), w)), ' ')"
    both = lambda x: f"array_to_string(list_transform({x}, lambda t: {prose('t')}), ' and ')"
    verb = lambda x: f"if({x} = 'built', 'are building', {x})"
    best = lambda table, prefix: f"select user_id, project_id, list(split_part(feature, ':', -1) order by round(signal, 9) desc, split_part(feature, ':', -1)) as best from picks join features using (project_id) join {table} using (user_id, feature) where feature like '{prefix}:%' and signal > 0 group by all"
    liked = lambda prefix: f"select user_id, project_id, max(signal) as liked from picks join features using (project_id) join long_term using (user_id, feature) where feature like '{prefix}:%' group by all"
    gated = lambda *cases: " ".join(f"when {when} then ' ' || {text}" for when, text in cases)
    also_now, heard, found, suits = ("now", "also_now"), ("others", "others_text"), ("new and explored", "new_text"), ("fit", "fit_text")
    also_taste = "'Your interest in ' || taste_prose || ' speaks for it too.'"
    return {
        "seed_names": """select user_id, project_id, list(title order by place)[1:2] as seed_titles, list(state order by place)[1:2] as seed_states from (select user_id, k.project_id, unnest(support) as seed_id, generate_subscripts(support, 1) as place
  from collaborative_scores k semi join picks using (user_id, project_id)) s join (select project_id as seed_id, title from catalog) using (seed_id) join (select user_id, project_id as seed_id, state from signals) using (user_id, seed_id) group by all""",
        "why_rows": f"""select p.user_id, p.project_id, p.final_rank, p.pre_rank, p.score, p.mmr, r.e, r.confidence, r.session, r.collaborative, r.novelty, r.popularity, string_split(r.sources, ',') as found_by, r.w_content, r.w_collaborative, r.w_novelty, coalesce(r.content, 0)::double as affinity,
    coalesce(t.best, [])[1:2] as tags2, coalesce(n.best, [])[1:2] as now2, coalesce(seed_titles, []) as titles, coalesce(seed_states, []) as verbs, p.user_id not in (select user_id from history where weight <> 0 and {AGE} <= 365) as cold,
    list_filter([case when du.liked > 0 then case {BUCKET} when 'UNDER_2_HOURS' then 'under-two-hour' when 'ONE_EVENING' then 'one-evening' when 'WEEKEND' then 'weekend-sized' else 'week-long' end end,
      case when di.liked > 0 then case difficulty when 'BEGINNER' then 'beginner-friendly' when 'INTERMEDIATE' then 'intermediate' else 'advanced' end end, l.best[1]], lambda x: x is not null) as fits
  from picks p join ranked r on r.user_id = p.user_id and r.project_id = p.project_id join catalog c on c.project_id = p.project_id
  left join ({best('long_term', 'tag')}) t on t.user_id = p.user_id and t.project_id = p.project_id left join ({best('session_profile', 'tag')}) n on n.user_id = p.user_id and n.project_id = p.project_id
  left join ({best('long_term', 'lang')}) l on l.user_id = p.user_id and l.project_id = p.project_id left join ({liked('difficulty')}) di on di.user_id = p.user_id and di.project_id = p.project_id
  left join ({liked('duration')}) du on du.user_id = p.user_id and du.project_id = p.project_id left join seed_names s on s.user_id = p.user_id and s.project_id = p.project_id""",
        "why_parts": """select *, len(tags2) > 0 and affinity >= 0.2 as taste, greatest(0, coalesce(session, 0))::double as now_score, coalesce(confidence >= 0.15, false) and len(now2) > 0 and session is not null and now_score >= 0.25 as now,
    len(fits) > 0 and affinity > 0 as fit, coalesce(popularity >= 0.5, false) and list_contains(found_by, 'popular') as popular_one, coalesce(collaborative >= 0.3, false) and len(titles) > 0 and list_contains(found_by, 'collaborative') as others,
    coalesce(w_content, 0) * greatest(0, affinity) as content_share, if(others, coalesce(w_collaborative, 0) * collaborative, 0) as others_share, others and (not taste or others_share > content_share) as others_lead, list_contains(found_by, 'exploration') as explored,
    4 * least(1, greatest(0, affinity)) * (1 - least(1, greatest(0, affinity))) >= 0.5 and len(tags2) > 0 as beside, 1 - least(1, greatest(0, popularity)) >= 0.6 as rare, coalesce(novelty >= 0.55, false) and affinity >= 0 and (beside or rare) as new, if(new, coalesce(w_novelty, 0) * novelty, 0) as new_share,
    new and new_share > content_share and new_share > others_share and not (taste and cold) as new_leads, now and (not taste or (coalesce(confidence >= 0.4, false) and now_score >= greatest(0, affinity))) as now_leads from why_rows""",
        "why_texts": f"""select *, {prose('tags2[1]')} as tag, {both('tags2')} as taste_prose, {both('now2')} as now_prose, 'Fits your preference for ' || array_to_string(fits, ' ') || ' projects.' as fit_text, 'You''ve also been exploring ' || now_prose || ' this session.' as also_now,
    case when len(titles) < 2 then 'People who liked “' || titles[1] || '”, which you ' || {verb('verbs[1]')} || ', also liked this.' when verbs[1] = verbs[2] then 'People who liked “' || titles[1] || '” and “' || titles[2] || '”, which you ' || {verb('verbs[1]')} || ', also liked this.'
      else 'People who liked “' || titles[1] || '” (which you ' || {verb('verbs[1]')} || ') and “' || titles[2] || '” (which you ' || {verb('verbs[2]')} || ') also liked this.' end as others_text,
    case when e >= 0.6 and explored and tag is not null then 'You''re in a more adventurous discovery mode, so us is showing a less familiar project related to ' || tag || '.' when beside then 'A bit of a wildcard: this explores an adjacent area while still matching your ' || tag || ' interests.'
      when rare and tag is not null then 'This is less commonly explored, but still overlaps with your interest in ' || tag || '.' else 'Few others have found this one yet.' end as new_text from why_parts""",
        "reasons": f"""select user_id, project_id, final_rank, pre_rank::int as pre_rank, score, mmr,
    case when others_lead and others_share >= new_share then 'collaborative' when new_leads then 'novelty' when now_leads then 'session' when taste and cold then 'onboarding' when taste then 'taste' when fit then 'fit' when explored and new then 'novelty'
      when popular_one then 'popularity' when affinity > 0 and len(tags2) > 0 then 'taste' else 'catalog' end as "primary",
    case when others_lead and others_share >= new_share then others_text || case {gated(('taste', also_taste), also_now, ('new', 'new_text'), suits)} else '' end
      when new_leads then new_text || case {gated(("taste and not contains(new_text, 'interest')", also_taste), heard)} else '' end
      when now_leads then if(taste, 'Your current session has shifted towards ' || now_prose || ', while this still matches your broader ' || taste_prose || ' interests.', 'You''ve been exploring ' || now_prose || ' projects in this session.' || case {gated(heard, suits)} else '' end)
      when taste and cold then 'Based on the interests you selected during onboarding: ' || taste_prose || '.' || case {gated(also_now, found, suits)} else '' end
      when taste then 'Because you like ' || taste_prose || ' projects.' || case {gated(also_now, heard, found, suits)} else '' end
      when fit then fit_text when explored and new then new_text when popular_one then if(tag is null, 'Popular with us users — a good place to start.', 'Popular with us users, and related to your interest in ' || tag || '.')
      when affinity > 0 and len(tags2) > 0 then 'Has to do with your interest in ' || tag || '.' else 'From the us catalog.' end as text,
    array_to_string(list_filter([if(taste, if(cold, 'onboarding', 'taste') || '(' || array_to_string(tags2, ',') || ')', null), if(now, 'session(' || array_to_string(now2, ',') || ')', null), if(fit, 'fit(' || array_to_string(fits, ',') || ')', null), if(popular_one, 'popularity()', null),
      if(others, 'collaborative(' || array_to_string(titles, ',') || ')', null), if(new, 'novelty(' || coalesce(tags2[1], '') || ')', null), if("primary" = 'taste' and not taste, 'taste(' || tags2[1] || ')', null), if("primary" = 'catalog', 'catalog()', null)], lambda x: x is not null), ' ') as factors,
    round(if(taste, affinity, 0) + if(now, now_score, 0) + if(fit, affinity, 0) + if(popular_one, popularity, 0) + if(others, collaborative, 0) + if(new, novelty, 0) + if("primary" = 'taste' and not taste, affinity, 0), 6) as strength from why_texts""",
    }
