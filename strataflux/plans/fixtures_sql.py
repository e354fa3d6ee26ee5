"""The derived tables of `sources.tables` as SQL common table expressions."""

PIXELS = """pixels as (
  select event_id // 4096 as img, (event_id // 64) % 64 as y, event_id % 64 as x,
         cast(floor(value * 100) as bigint) % 256 as r, user_id % 256 as g,
         (event_id * 7919) % 256 as b
  from events)"""

FRAMED = PIXELS + """, framed as (
  select img, y, x,
         case when edge then img % 2 * 40 + 60 else r end as r,
         case when edge then img % 2 * 40 + 65 else g end as g,
         case when edge then img % 2 * 40 + 69 else b end as b
  from (select *, (x < 2 + img % 5 or y < 3 + img % 3 or x >= 61 or y >= 62 - img % 2) as edge from pixels))"""

SAMPLES = """samples as (
  select vec_id as sample_id, cast(i - 1 as bigint) as idx, cast(embedding[i] as double) as amp
  from (select vec_id, embedding, unnest(range(1, len(embedding) + 1)) as i from embeddings))"""

COEFS = SAMPLES + """, coefs as (
  select sample_id // 768 as img, (sample_id // 256) % 3 as comp, (sample_id // 16) % 16 as by_,
         sample_id % 16 as bx, idx as k, cast(floor(amp * 20) as bigint) as coef
  from samples)"""

PACKETS = """packets as (
  select user_id % 8 as stream, event_id as seq,
         case when event_type = 'signup' then 'header' else 'packet' end as kind,
         case event_type
           when 'signup' then case when event_id % 2 = 0 then 192 + user_id % 6 else 224 + user_id % 3 end
           when 'click' then 192 + event_id % 6
           when 'view' then 224 + event_id % 3
           when 'purchase' then 188 + event_id % 4
           else 240 + event_id % 16 end as stream_id,
         (epoch_us(ts) * 9 // 100) % 8589934592 as scr_ticks,
         cast(floor(value * 100) as bigint) as mux_rate,
         cast(6 as bigint) as hdr_bytes, length(props) as payload_bytes, props as payload
  from events)"""

PICTURES = """pictures as (
  select user_id % 8 as stream, event_id as decode_no,
         case event_type when 'signup' then 'I' when 'purchase' then 'P' else 'B' end as ptype
  from events)"""

DELTAS = """deltas as (
  select l_suppkey as part, l_orderkey as ord1, l_partkey as ord2, cast(l_linenumber as bigint) as ord3,
         cast(l_quantity as bigint) - 25 as delta, l_returnflag = 'R' as reset
  from lineitem)"""

STEP_BYTES = """step_bytes as (
  select user_id as part, event_id as pos, cast(floor(value * 100) as bigint) % 256 as b
  from events)"""


def with_(*ctes: str) -> str:
    return "with " + ",\n".join(ctes) + "\n"
