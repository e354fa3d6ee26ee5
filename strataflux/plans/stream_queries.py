"""Registered queries over packets, pictures and audio samples."""

from __future__ import annotations

from pyspark.sql import functions as F

from strataflux.operators import audio as A
from strataflux.operators import streams as S
from strataflux.plans import fixtures_sql as X
from strataflux.plans.numeric_queries import q6, r6
from strataflux.plans.registry import query
from strataflux.sources import tables as T


def packets(spark, d):
    return T.packets(T.table(spark, d, "events"))


def pictures(spark, d):
    return T.pictures(T.table(spark, d, "events"))


def samples(spark, d):
    return T.samples(T.table(spark, d, "embeddings"))


DECLARED = X.PACKETS + """, since as (select stream, stream_id, min(seq) as since from packets where kind = 'header' group by all), marked as (
  select p.*, coalesce(since < seq, false) as declared from packets p left join since using (stream, stream_id) where kind = 'packet')"""
_COLS = "stream, stream_id, seq, kind, scr_ticks, mux_rate, hdr_bytes, payload_bytes, payload"


@query("classify_packets", X.with_(DECLARED) + f"select {_COLS}, declared, " + """case
  when declared and stream_id between 192 and 223 then 'audio' when declared and stream_id between 224 and 239 then 'video'
  when stream_id = 190 then 'padding' when stream_id = 188 then 'reserved' when stream_id = 189 then 'private_1' when stream_id = 191 then 'private_2'
  when stream_id between 192 and 223 then 'undeclared_audio' when stream_id between 224 and 239 then 'undeclared_video' else 'unknown' end as cls from marked""")
def classify_packets(spark, d):
    return S.classify(packets(spark, d))


@query("undeclared_streams", X.with_(DECLARED) + f"""select {_COLS}, seq > min(seq) over (partition by stream, stream_id) as adopted
from marked where not declared and stream_id between 192 and 239""")
def undeclared_streams(spark, d):
    return S.undeclared_streams(packets(spark, d))


@query("declared_packets", X.with_(DECLARED) + "select stream, seq from marked where declared")
def declared_packets(spark, d):
    return S.with_declared(packets(spark, d)).where("declared").select("stream", "seq")


@query("stream_stats", X.with_(X.PACKETS) + """, f as (select *, kind = 'packet' and stream_id between 192 and 223 as a, kind = 'packet' and stream_id between 224 and 239 as v,
  kind = 'packet' as p from packets)
select stream, count(*) filter (not p) as headers, count(*) filter (p) as packets, count(*) filter (a) as audio, count(*) filter (v) as video,
  count(*) filter (p and stream_id = 190) as padding, count(*) filter (p and stream_id = 188) as reserved, count(*) filter (p and stream_id = 189) as private_1,
  count(*) filter (p and stream_id = 191) as private_2, count(*) filter (p and stream_id > 239) as unknown,
  cast(sum(case when a then payload_bytes else 0 end) as bigint) as audio_bytes, cast(sum(case when v then payload_bytes else 0 end) as bigint) as video_bytes,
  cast(sum(hdr_bytes + case when a or v then 0 else payload_bytes end) as bigint) as system_bytes from f group by stream""")
def stream_stats(spark, d):
    return S.stream_stats(packets(spark, d))


_CHOSEN = X.PACKETS + """, chosen as (select stream, arg_min(stream_id, seq) as stream_id from packets where stream_id between 224 and 239 group by stream)"""


@query("first_video_stream", X.with_(_CHOSEN) + f"select {_COLS} from packets join chosen using (stream, stream_id)")
def first_video_stream(spark, d):
    return S.first_stream(packets(spark, d))


@query("reassemble", X.with_(_CHOSEN) + """
select stream, stream_id, seq, cast(sum(payload_bytes) over (partition by stream order by seq rows unbounded preceding) as bigint) - payload_bytes as start_byte, payload_bytes, payload
from packets join chosen using (stream, stream_id) where kind = 'packet'""")
def reassemble(spark, d):
    return S.reassemble(packets(spark, d))


@query("clock_gaps", X.with_(X.PACKETS) + """, g as (
  select *, ((scr_ticks - lag(scr_ticks) over (partition by stream order by seq)) % 8589934592 + 8589934592) % 8589934592 as gap from packets)
select stream, seq, scr_ticks, gap as gap_ticks, """ + q6("gap / 90000.0::double") + " as gap_seconds, "
       + "case when gap = 0 then null else " + q6("payload_bytes / nullif(gap / 90000.0::double, 0)") + " end as bytes_per_second, mux_rate * 50 as declared_rate from g")
def clock_gaps(spark, d):
    done = S.clock_gaps(packets(spark, d))
    return done.withColumn("gap_seconds", r6(F.col("gap_seconds"))).withColumn("bytes_per_second", r6(F.col("bytes_per_second")))


@query("reference_pictures", X.with_(X.PICTURES) + """, refs as (
  select stream, decode_no as ref, lag(decode_no) over (partition by stream order by decode_no) as prior from pictures where ptype <> 'B'), found as (
  select p.*, r.ref, r.prior from pictures p asof left join refs r on p.stream = r.stream and r.ref < p.decode_no)
select stream, decode_no, ptype, case ptype when 'B' then prior when 'P' then ref end as past_no, case when ptype = 'B' then ref end as future_no from found""")
def reference_pictures(spark, d):
    return S.reference_pictures(pictures(spark, d))


@query("display_order", X.with_(X.PICTURES) + """, refs as (
  select stream, decode_no, lead(decode_no) over (partition by stream order by decode_no) as nxt from pictures where ptype <> 'B'), timed as (
  select p.*, case when ptype = 'B' then p.decode_no else coalesce(nxt, 4611686018427387904) end as at_ from pictures p left join refs using (stream, decode_no))
select stream, decode_no, ptype, row_number() over (partition by stream order by at_) as display_no from timed""")
def display_order(spark, d):
    return S.display_order(pictures(spark, d))


@query("group_of_pictures", X.with_(X.PICTURES) + """
select stream, decode_no, ptype, cast(sum(case when ptype = 'I' then 1 else 0 end) over (partition by stream order by decode_no rows unbounded preceding) as bigint) as gop_no from pictures""")
def group_of_pictures(spark, d):
    return S.group_id(pictures(spark, d), F.col("ptype") == "I")


# --- audio ---------------------------------------------------------------

_NOTES = ["c", "C#", "d", "D#", "E", "F", "f#", "G", "G#", "A", "A#", "b", "H", "E#"]


def _notes(spark, d):
    names = F.array(*[F.lit(n) for n in _NOTES])
    return T.table(spark, d, "events").select("event_id", F.element_at(names, (F.col("event_id") % len(_NOTES) + 1).cast("int")).alias("note"))


_NOTE_SQL = f"""notes as (select event_id, {_NOTES}[event_id % {len(_NOTES)} + 1] as note from events), tab(name, divisor) as (values
  ('C', 98), ('C#', 93), ('D', 89), ('D#', 83), ('E', 79), ('F', 75), ('F#', 71), ('G', 68), ('G#', 65), ('A', 59), ('A#', 55), ('B', 53))"""


@query("rate_for_note", "with " + _NOTE_SQL + " select event_id, note, divisor from notes left join tab on upper(note) = name")
def rate_for_note(spark, d):
    return A.rate_for_note(_notes(spark, d))


@query("illegal_notes", "with " + _NOTE_SQL + " select event_id, note from notes where upper(note) not in (select name from tab)")
def illegal_notes(spark, d):
    return A.illegal_notes(_notes(spark, d))


@query("divisor_for_khz", """
select event_id, event_id % 30 as khz, case when event_id % 30 between 5 and 22 then [113,91,75,63,54,47,41,36,32,28,25,22,20,18,16,14,13,11][event_id % 30 - 4] end as divisor from events""")
def divisor_for_khz(spark, d):
    return A.divisor_for_khz(T.table(spark, d, "events").select("event_id", (F.col("event_id") % 30).alias("khz")))


@query("sample_copy", X.with_(X.SAMPLES) + "select sample_id, idx - 10 + 100 as idx, amp from samples where idx >= 10 and idx < 40")
def sample_copy(spark, d):
    return A.sample_copy(samples(spark, d), 10, 40, 100)


@query("sample_direction", X.with_(X.SAMPLES) + """
select sample_id, 63 - idx + l * 64 as idx, amp from samples, (select unnest([0, 1, 2]) as l)""")
def sample_direction(spark, d):
    return A.sample_direction(samples(spark, d), backward=True, loops=3)


def _resampled(a, b):
    n = -(-64 * b // a)
    return X.with_(X.SAMPLES) + f""", outs as (select vec_id as sample_id, unnest(range(0, {n})) as i from embeddings)
select s.sample_id, i as idx, amp from outs join samples s on s.sample_id = outs.sample_id and s.idx = i * {a} // {b}"""


@query("resample_down", _resampled(98, 59))
def resample_down(spark, d):
    return A.resample(samples(spark, d), "98", "59")


@query("resample_up", _resampled(53, 75))
def resample_up(spark, d):
    return A.resample(samples(spark, d), "53", "75")


@query("sample_checks", """
with req as (select event_id as req_id, user_id * 5 as sample_id, event_id % 50 as s, user_id % 60 as e, event_id % 30 as khz from events)
select req_id, sample_id, reason from (select req_id, sample_id, case when vec_id is null then 'sample not found' when e <= s then 'end not above start'
  when khz not between 5 and 22 then 'rate out of range' end as reason from req left join embeddings on vec_id = sample_id) where reason is not null""")
def sample_checks(spark, d):
    req = T.table(spark, d, "events").select(
        F.col("event_id").alias("req_id"), (F.col("user_id") * 5).alias("sample_id"), (F.col("event_id") % 50).alias("start"),
        (F.col("user_id") % 60).alias("end"), (F.col("event_id") % 30).alias("khz"))
    return A.sample_checks(req, samples(spark, d))


@query("spectrum", X.with_(X.SAMPLES) + """, f as (
  select sample_id, idx // 32 as frame, idx % 32 as n, amp from samples), ft as (
  select sample_id, frame, k, sum(amp * cos(2 * pi() * ((k * n) % 32) / 32)) as re, -sum(amp * sin(2 * pi() * ((k * n) % 32) / 32)) as im
  from f, (select unnest(range(0, 32)) as k) group by sample_id, frame, k)
select sample_id, frame, k, """ + f"{q6('re', 5)} as re, {q6('im', 5)} as im, {q6('re * re + im * im', 5)} as energy from ft")
def spectrum(spark, d):
    done = A.spectrum(samples(spark, d), 32)
    return done.select("sample_id", "frame", "k", *[r6(F.col(c), 5).alias(c) for c in ("re", "im", "energy")])
