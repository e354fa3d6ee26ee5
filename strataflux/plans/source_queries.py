"""Registered queries over binary content built from the tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from strataflux.functions import media
from strataflux.operators import streams as S
from strataflux.operators.scan import RunningSum, scan
from strataflux.plans import fixtures_sql as X
from strataflux.plans.registry import query
from strataflux.session import scratch_path
from strataflux.sources import binaries as N
from strataflux.sources import ranges as G
from strataflux.sources.tables import packets, table


def _content(df, path, *pieces):
    """`(path, content)` from hex text pieces."""
    return df.select(F.expr(path).alias("path"), F.unhex(F.concat(*[F.expr(p) for p in pieces])).alias("content"))


def h(value, digits):
    return f"lpad(hex({value}), {digits}, '0')"


@query("inventory", """
with t as (select case when event_id % 9 = 8 then 'empty' when event_id % 9 = 7 then 'text' else
    ['png', 'jpeg', 'mpeg_system', 'mpeg_video', 'iff', 'program', 'raster'][event_id % 9 + 1] end as type,
  case event_id % 9 when 8 then 0 when 7 then 0 when 6 then 0 when 5 then 2 when 1 then 3 else 4 end + case when event_id % 9 = 8 then 0 else length(props) end as n from events)
select type, count(*) as files, cast(sum(n) as bigint) as bytes from t group by type""")
def inventory(spark, d):
    magic = "element_at(array('89504E47','FFD8FF','000001BA','000001B3','464F524D','601A','',''), cast(event_id % 9 + 1 as int))"
    files = _content(table(spark, d, "events"), "concat('f', event_id, if(event_id % 9 = 6, '.IMG', ''))",
                     f"if(event_id % 9 = 8, '', concat({magic}, hex(props)))")
    return N.inventory(files)


_WORDS = {"version": "p_size % 4 - 1", "head_words": "cast(8 as bigint)", "planes": "p_partkey % 5", "pat_run": "p_size % 3",
          "pix_width": "cast(85 as bigint)", "pix_height": "cast(85 as bigint)", "width": "p_partkey % 700 - 3", "height": "p_size * 40"}


def _rasters(spark, d):
    return N.raster_headers(_content(table(spark, d, "part"), "cast(p_partkey as string)", *[
        f"lpad(hex((({w}) + 65536) % 65536), 4, '0')" for w in _WORDS.values()], "hex(p_name)"))


_RASTER_SQL = "with r as (select cast(p_partkey as varchar) as path, " + ", ".join(
    f"cast({w} as bigint) as {n}" for n, w in _WORDS.items()) + " from part) select * from r where "
_GOOD = "(width > 0 and height > 0 and planes > 0 and version >= 0 and pat_run >= 0)"


@query("raster_headers", _RASTER_SQL + _GOOD)
def raster_headers(spark, d):
    return _rasters(spark, d)[0]


@query("raster_rejects", _RASTER_SQL + "not " + _GOOD)
def raster_rejects(spark, d):
    return _rasters(spark, d)[1]


@query("program_headers", """
with p as (select cast(p_partkey as varchar) as path, p_size * 4 as t, p_partkey % 7 as da, p_size * 10 as b, p_partkey % 3 * 14 as s, p_partkey % 6 as n from part), q as (
  select *, case when n = 0 then 4 else 4 + n end as fx from p)
select path, cast(28 + t + da + fx + s as bigint) as file_bytes, cast(t as bigint) as text_bytes, da as data_bytes, cast(b as bigint) as bss_bytes, s as symbol_bytes,
  t + da + b as memory_bytes, fx + s as extra_bytes, fx as fixup_bytes, cast(0 as bigint) as unaccounted from q""")
def program_headers(spark, d):
    files = _content(
        table(spark, d, "part"), "cast(p_partkey as string)", "'601A'", h("p_size * 4", 8), h("p_partkey % 7", 8), h("p_size * 10", 8),
        h("p_partkey % 3 * 14", 8), "repeat('0', 20)", "repeat('A5', p_size * 4 + cast(p_partkey % 7 as int))",
        "if(p_partkey % 6 = 0, '00000000', concat('00000102', repeat('0C', cast(p_partkey % 6 - 1 as int)), '00'))",
        "repeat('5A', cast(p_partkey % 3 * 14 as int))")
    return N.program_headers(files)[0]


@query("pixmap_pixels", """
with m as (select cast(p_partkey as varchar) as img, md5(p_name || p_partkey) as m, unnest(range(0, 5)) as i from part)
select img, cast(0 as bigint) as y, i as x, """ + ", ".join(
    f"cast('0x' || substr(m, 6 * i + {2 * j + 1}, 2) as bigint) as {c}" for j, c in enumerate("rgb")) + " from m")
def pixmap_pixels(spark, d):
    return N.read_pixels(_content(table(spark, d, "part"), "cast(p_partkey as string)", "hex(concat('P6\n# made\n5 1\n255\n'))",
                                  "substring(md5(concat(p_name, p_partkey)), 1, 30)"))


@query("image_markers", """
with p as (select cast(p_partkey as varchar) as path, p_name, p_size, p_partkey from part)
select path, cast(254 as bigint) as marker, cast(2 as bigint) as at, null::varchar as process, null::bigint as width, null::bigint as height,
  null::bigint as components, null::bigint as precision, p_name || '\\\\\\001' as note from p
union all
select path, 192 + p_partkey % 4, 2 + 4 + length(p_name) + 2, ['Baseline', 'Extended sequential', 'Progressive', 'Lossless'][p_partkey % 4 + 1],
  p_size * 8, p_size * 6, 3, 8, null from p""")
def image_markers(spark, d):
    files = _content(
        table(spark, d, "part"), "cast(p_partkey as string)", "'FFD8FFFE'", h("length(p_name) + 4", 4), "hex(p_name)", "'5C01'",
        "concat('FF', hex(192 + p_partkey % 4), '001108')", h("p_size * 6", 4), h("p_size * 8", 4), "'03'", "repeat('011100', 3)", "'FFDA0004FFFE0003AA'")
    return N.image_markers(files)


@query("marker_summary", """
select ['Baseline', 'Extended sequential', 'Progressive', 'Lossless'][p_partkey % 4 + 1] as process, cast(3 as bigint) as components, cast(8 as bigint) as precision,
  count(*) as images, cast(max(p_size * 8 * p_size * 6) as bigint) as most_pixels from part group by p_partkey % 4""")
def marker_summary(spark, d):
    return N.marker_summary(image_markers(spark, d))


@query("marker_fields", """
with p as (select cast(p_partkey as varchar) as path, p_size, p_partkey, cast(2 + 6 as bigint) as dqt from part), f as (
select path, cast(221 as bigint) as marker, cast(2 as bigint) as at, 'interval' as field, cast(p_partkey % 65536 as bigint) as value, null::varchar as error from p
union all select path, 219, dqt, unnest(['bytes1', 'sum1', 'tables']), unnest([1, 64 * (p_size % 256), 1]), null from p where p_size % 7 <> 0
union all select path, 219, dqt, null, null, 'short quantization table' from p where p_size % 7 = 0
union all select path, 192 + p_partkey % 4, case when p_size % 7 = 0 then dqt + 2 + 2 + 2 else dqt + 2 + 2 + 65 end,
  unnest(['precision', 'height', 'width', 'components', 'h0', 'v0', 'table0']), unnest([8, p_size * 6, p_size * 8, 1, 1 + p_partkey % 4, 1 + p_size % 4, 1]), null from p)
select * from f""")
def marker_fields(spark, d):
    """Restart interval, one quantization table (cut off in some files) and a frame, each read by its handler; the comment has none."""
    table_body = "if(p_size % 7 = 0, concat('FFDB0004', '0105'), concat('FFDB0043', '01', repeat(lpad(hex(p_size % 256), 2, '0'), 64)))"
    files = _content(
        table(spark, d, "part"), "cast(p_partkey as string)", "'FFD8FFDD0004'", h("p_partkey % 65536", 4), table_body,
        "concat('FF', hex(192 + p_partkey % 4), '000B08')", h("p_size * 6", 4), h("p_size * 8", 4), "'0101'",
        "concat(hex(1 + p_partkey % 4), hex(1 + p_size % 4))", "'01'", "'FFFE0004AABB'", "'FFDA0004'")
    return N.process_markers(files)


def _system_stream(spark, d):
    """Pack, header declaring two ids, padding, a packet with a false code in its payload, end code; junk first."""
    ticks = "(event_id * 1000003 % 8589934592)"
    bits = (f"({ticks} div 4294967296 * 8 + ({ticks} div 1073741824) % 4 * 2 + 33)", f"({ticks} div 4194304 % 256)",
            f"(({ticks} div 32768 % 128) * 2 + 1)", f"({ticks} div 128 % 256)", f"({ticks} % 128 * 2 + 1)")
    rate = "(user_id + 7)"
    return _content(
        table(spark, d, "events"), "cast(event_id as string)", "repeat('EE', cast(event_id % 3 as int))", "'000001BA'", *[h(b, 2) for b in bits],
        f"{h(f'({rate} div 32768) + 128', 2)}", h(f"({rate} div 128) % 256", 2), h(f"{rate} % 128 * 2 + 1", 2),
        "'000001BB000C800001042FFFC0C020E0E02E'", "concat('000001', hex(224 + event_id % 2))", h("length(props) + 5", 4), "'0F000001C0'", "hex(props)", "'000001B9'")


@query("packet_records", """
with e as (select cast(event_id as varchar) as stream, event_id % 3 as j, event_id, user_id, length(props) as n from events)
select stream, cast(0 as bigint) as seq, j as at, 'pack' as kind, null::bigint as stream_id, (event_id * 1000003) % 8589934592 as scr_ticks, user_id + 7 as mux_rate,
  cast(12 as bigint) as hdr_bytes, cast(0 as bigint) as payload_bytes, j as skipped_bytes from e
union all select stream, 1, j + 12, 'header', 192, null, null, 18, 0, 0 from e
union all select stream, 2, j + 12, 'header', 224, null, null, 0, 0, 0 from e
union all select stream, 3, j + 30, 'packet', 224 + event_id % 2, null, null, 7, n + 4, 0 from e""")
def packet_records(spark, d):
    return N.packet_records(_system_stream(spark, d))


@query("start_codes", """
with e as (select cast(event_id as varchar) as path, event_id % 3 as j, event_id, length(props) as n from events)
select path, j + o as at, code from (select path, j, unnest([0, 12, 30, 37, 41 + n]) as o, unnest([186, 187, 224 + event_id % 2, 192, 185]) as code from e)""")
def start_codes(spark, d):
    return N.scan_start_codes(_system_stream(spark, d), chunk_bytes=16)


def _written_streams(spark, d):
    """System streams written as files: the records of all events one after the other, without end codes."""
    body = _system_stream(spark, d).withColumn("content", F.expr("substring(content, 1, length(content) - 4)"))
    rows = body.select((F.col("path").cast("bigint") % 5).alias("stream"), F.col("path").cast("bigint").alias("seq"), F.col("content").alias("payload"), F.length("content").cast("bigint").alias("n"))
    placed = scan(rows, ["stream"], ["seq"], {"_end": RunningSum(F.col("n"))})
    path = scratch_path(spark, "system")
    G.write_payload(placed.select("stream", (F.col("_end") - F.col("n")).alias("start_byte"), "payload"), path)
    return path


@query("packet_ranges", """
with e as (select event_id % 3 as j, event_id, user_id, length(props) as n from events), r as (
  select 'pack' as kind, null::bigint as stream_id, (event_id * 1000003) % 8589934592 as ticks, user_id + 7 as rate, 12 as hdr, 0 as payload, j as skipped from e
  union all select 'header', 192, null, null, 18, 0, 0 from e
  union all select 'header', 224, null, null, 0, 0, 0 from e
  union all select 'packet', 224 + event_id % 2, null, null, 7, n + 4, 0 from e)
select kind, stream_id, count(*) as n, cast(sum(ticks) as bigint) as ticks, cast(sum(rate) as bigint) as rate, cast(sum(hdr) as bigint) as hdr_bytes,
  cast(sum(payload) as bigint) as payload_bytes, cast(sum(skipped) as bigint) as skipped_bytes from r group by kind, stream_id""")
def packet_ranges(spark, d):
    """Packets of long files, each cut into many ranges."""
    found = G.packets(G.read_ranges(spark, _written_streams(spark, d), ending=".bin", chunk_bytes=256 << 10))
    return found.groupBy("kind", "stream_id").agg(
        F.count(F.lit(1)).alias("n"), F.sum("scr_ticks").alias("ticks"), F.sum("mux_rate").alias("rate"), F.sum("hdr_bytes").alias("hdr_bytes"),
        F.sum("payload_bytes").alias("payload_bytes"), F.sum("skipped_bytes").alias("skipped_bytes"))


@query("payload_written", X.with_(X.PACKETS) + """, chosen as (
  select stream, arg_min(stream_id, seq) as stream_id from packets where stream_id between 224 and 239 group by stream)
select cast(stream as varchar) as stream, cast(sum(octet_length(encode(payload))) as bigint) as bytes, sha256(string_agg(payload, '' order by seq)) as sha256
from packets join chosen using (stream, stream_id) where kind = 'packet' group by stream""")
def payload_written(spark, d):
    """The payload of each stream's first video id, written as raw bytes and read back."""
    path = scratch_path(spark, "payload")
    G.write_payload(S.reassemble(packets(table(spark, d, "events"))), path)
    return G.stream_digests(G.read_payload(spark, path))


@query("byte_checksum", """
with b as (select doc_id, hex(encode(text)) as x from documents), s as (
  select doc_id, coalesce(list_sum(list_transform(regexp_extract_all(x, '..'), lambda p: cast('0x' || p as bigint))), 0) as t from b)
select doc_id, cast(t % 256 as bigint) as plain, cast(255 - t % 256 as bigint) as ones, cast((256 - t % 256) % 256 as bigint) as twos from s""")
def byte_checksum(spark, d):
    summed = table(spark, d, "documents").select("doc_id", media.byte_sum(F.encode("text", "UTF-8")).alias("t"))
    return summed.select("doc_id", *[media.complement(F.col("t"), k).alias(n) for n, k in (("plain", "none"), ("ones", "ones"), ("twos", "twos"))])


_CUT = """b as (select item_id, hex(encode(text)) as x, octet_length(encode(text)) as n from benchmark), c as (
  select item_id, a, substr(x, 2 * a + 1, 64) as data from (select item_id, x, unnest(range(0, n, 32)) as a from b)), s as (
  select *, length(data) // 2 as n, list_sum(list_transform(range(0, length(data) // 2), lambda i: cast('0x' || substr(data, 2 * i + 1, 2) as bigint))) as t,
    list_sum(list_transform(range(0, length(data)), lambda i: cast('0x' || substr(data, i + 1, 1) as bigint))) as nb from c)"""
_HEX_SQL = {
    "s": ("'S2' || printf('%02X', n + 4) || printf('%06X', a) || data || printf('%02X', cast(255 - (t + n + 4 + a % 256 + a // 256 % 256 + a // 65536 % 256) % 256 as bigint))", "S804000000FB"),
    "intel": ("':' || printf('%02X', n) || printf('%04X', a % 65536) || '00' || data || printf('%02X', cast((256 - (t + n + a % 256 + a // 256 % 256) % 256) % 256 as bigint))", ":0000000000"),
    "tek": ("'/' || printf('%04X', a % 65536) || printf('%02X', n) || printf('%02X', cast(a % 16 + a // 16 % 16 + a // 256 % 16 + a // 4096 % 16 + n % 16 + n // 16 as bigint)) || data || printf('%02X', cast(nb % 256 as bigint))", "/00000000"),
}
for _fmt, (_line, _last) in _HEX_SQL.items():
    query(f"hex_records_{_fmt}", f"with {_CUT} select item_id, a as addr, {_line} as line from s union all select item_id, n, '{_last}' from b")(
        lambda spark, d, _fmt=_fmt: N.to_hex_records(
            table(spark, d, "benchmark").select("item_id", F.encode("text", "UTF-8").alias("content")), "item_id", _fmt))


@query("hex_records_written", "select doc_id % 10 as bucket, cast(sum(coalesce((octet_length(encode(text)) + 31) // 32, 0) + 1) as bigint) as n from documents group by 1")
def hex_records_written(spark, d):
    path = scratch_path(spark, "hex")
    docs = table(spark, d, "documents").select("doc_id", F.encode("text", "UTF-8").alias("content"))
    lines = N.to_hex_records(docs, "doc_id", "s")
    N.write_hex_records(lines.withColumn("line", F.concat_ws(" ", F.col("doc_id") % 10, "line")), "doc_id", path)
    return spark.read.text(path).groupBy(F.substring_index("value", " ", 1).cast("bigint").alias("bucket")).agg(F.count(F.lit(1)).alias("n"))
