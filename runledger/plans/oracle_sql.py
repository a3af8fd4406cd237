"""DuckDB helpers shared by oracle SQL strings."""

from runledger.schemas import STATES, TERMINAL_STATES, TRANSITION_KEYS

TRANSITIONS_LIST = "[" + ", ".join(f"'{k}'" for k in TRANSITION_KEYS) + "]"
TERMINAL_LIST = "(" + ", ".join(f"'{s}'" for s in TERMINAL_STATES) + ")"
STATES_LIST = "(" + ", ".join(f"'{s}'" for s in STATES) + ")"


def valid_sql(frm: str, to: str) -> str:
    return f"coalesce({frm} = {to} or list_contains({TRANSITIONS_LIST}, {frm} || '>' || {to}), false)"


# Recursive walk of job_log: one row per request with from_state / accepted.
REPLAY_WALK = f"""
req as (
  select job_id, seq, recorded_at, to_state,
         row_number() over (partition by job_id order by seq) as rn
  from job_log),
walk as (
  select job_id, 0::bigint as rn, null::bigint as seq, null::timestamp as recorded_at,
         null::varchar as to_state, null::varchar as from_state, null::boolean as accepted,
         'pending' as st, 0::bigint as applied, 0::bigint as rejected
  from (select distinct job_id from job_log)
  union all
  select w.job_id, r.rn, r.seq, r.recorded_at, r.to_state, w.st,
         {valid_sql('w.st', 'r.to_state')},
         case when {valid_sql('w.st', 'r.to_state')} then r.to_state else w.st end,
         w.applied + case when {valid_sql('w.st', 'r.to_state')} then 1 else 0 end,
         w.rejected + case when {valid_sql('w.st', 'r.to_state')} then 0 else 1 end
  from walk w join req r on r.job_id = w.job_id and r.rn = w.rn + 1)
"""
