"""Captured wire frames -> messages.

A session is one transmission of at most 4 096 accepted frames; refused and repeated frames do not count. Whether a frame
is accepted depends only on the number expected before it, so a session is cut into chunks of its frames, each chunk is
summarised for the eight numbers that may be expected at its start, and the summaries are put in order. Only accepted
frames, up to the limit, meet in one array; frames beyond it mark the session instead of growing it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import computed_once, let

MAX_FRAMES = 4096
CHUNK = 256  # frame positions folded together
MAX_FRAME_CHARS = {"LIS01_A": 64_000, "E1381_95": 240}
ETX, ETB = 0x03, 0x17
# Fixed value: characters that may not appear inside frame text.
RESTRICTED = r"[\x00-\x06\x08\x0A\x0E-\x1F\x7F\xFF]"


def parsed(frames: DataFrame) -> DataFrame:
    """Frame bytes (number, text, terminator, two checksum digits, CR LF, without STX) -> columns."""
    latin = F.decode("bytes", "ISO-8859-1")
    shape = r"(?s)\A(\d)(.*?)([\x03\x17])(.{2})\r\n\z"
    rows = frames.withColumn("_t", latin)

    def group(n: int) -> Column:
        return F.regexp_extract("_t", shape, n)

    return rows.select(
        *[c for c in frames.columns], F.col("_t").rlike(shape).alias("well_formed"),
        group(1).try_cast("int").alias("frame_no"), group(2).alias("text"),
        F.when(group(3) == "\u0003", "ETX").when(group(3) == "\u0017", "ETB").alias("terminator"),
        group(4).alias("checksum"), F.length("_t").alias("frame_chars"),
    )


def checksum_of(frame_no: Column, text: Column, terminator: Column) -> Column:
    """(digit + text + terminator) modulo 256 as two upper-case hex digits."""
    codes = F.transform(F.split(text, ""), lambda c: F.when(c == "", 0).otherwise(F.ascii(c)))
    latin = F.aggregate(codes, F.lit(0), lambda a, c: a + c)
    end = F.when(terminator == "ETX", ETX).otherwise(ETB)
    return F.lpad(F.hex(F.pmod(frame_no + 48 + latin + end, F.lit(256))), 2, "0")


def frame_issue(version: str = "LIS01_A", exact_case: bool = False) -> Column:
    """Why a parsed frame is refused; NULL for a good one."""
    expected = checksum_of(F.col("frame_no"), F.col("text"), F.col("terminator"))
    given = F.col("checksum") if exact_case else F.upper("checksum")
    return (
        F.when(~F.col("well_formed"), "shape")
        .when(F.length("text") > MAX_FRAME_CHARS[version], "size")
        .when(F.col("text").rlike(RESTRICTED), "character")
        .when(given != expected, "checksum")
    )


def sequenced(frames: DataFrame, issue: Column, max_frames: int = MAX_FRAMES, chunk: int = CHUNK) -> DataFrame:
    """Per session, the accepted frames in order. A refused frame does not move the expected number; an exact
    repeat of the previous frame is accepted and ignored.

    ``seq`` numbers a session's frames; each number is used once. ``n_accepted`` counts all accepted frames, ``accepted``
    holds the first ``max_frames`` of them, and ``over_limit`` tells whether there are more.
    """
    signature = F.sha2(F.concat_ws("\u0001", F.col("frame_no").cast("string"), "text", "terminator", "checksum"), 256)
    frame = F.struct("seq", "frame_no", "text", "terminator", "checksum", "_bad", signature.alias("_signature"))
    chunks = frames.withColumn("_bad", issue.isNotNull()).groupBy("session_id", F.floor(F.col("seq") / chunk).alias("_chunk")).agg(
        F.array_sort(F.collect_list(frame)).alias("_f"))

    def state(expected: Column, taken: Column, last: Column) -> Column:
        return F.struct(expected.cast("int").alias("expected"), taken.cast("int").alias("taken"), last.cast("string").alias("last"))

    def move(s: Column, f: Column) -> Column:
        taken = state(F.pmod(s["expected"] + 1, F.lit(8)), s["taken"] + 1, f["_signature"])
        return F.when(s["expected"] == f["frame_no"], taken).otherwise(s)

    every = F.array(*[state(F.lit(k), F.lit(0), F.lit(None)) for k in range(8)])
    ends = F.aggregate("_f", every, lambda acc, f: F.when(f["_bad"], acc).otherwise(F.transform(acc, lambda s: move(s, f))))
    summaries = chunks.select("session_id", F.struct("_chunk", ends.alias("ends")).alias("_c")).groupBy("session_id").agg(
        F.array_sort(F.collect_list("_c")).alias("_all"))

    def follow(acc: Column, c: Column) -> Column:
        at, here = acc["at"], F.get(c["ends"], acc["at"]["expected"])
        after = state(here["expected"], at["taken"] + here["taken"], F.coalesce(here["last"], at["last"]))
        begin = F.struct(c["_chunk"].alias("_chunk"), at.alias("_at"))
        return F.struct(after.alias("at"), F.concat(acc["begins"], F.array(begin)).alias("begins"))

    first = F.struct(state(F.lit(1), F.lit(0), F.lit(None)).alias("at"), F.array().cast(
        "array<struct<_chunk:bigint,_at:struct<expected:int,taken:int,last:string>>>").alias("begins"))
    begins = summaries.select("session_id", F.inline(F.aggregate("_all", first, follow, lambda acc: acc["begins"])))

    def step(acc: Column, f: Column) -> Column:
        repeat = ~f["_bad"] & (f["frame_no"] == F.pmod(acc["expected"] + 7, F.lit(8))) & F.coalesce(
            acc["last"] == f["_signature"], F.lit(False))
        accept = F.coalesce(~f["_bad"] & (f["frame_no"] == acc["expected"]), F.lit(False))
        return F.struct(
            F.when(accept, F.pmod(acc["expected"] + 1, F.lit(8))).otherwise(acc["expected"]).cast("int").alias("expected"),
            F.when(accept, f["_signature"]).otherwise(acc["last"]).alias("last"),
            (acc["repeated"] + F.when(repeat, 1).otherwise(0)).alias("repeated"),
            F.concat(acc["marks"], F.array(accept)).alias("marks"))

    start = F.struct(F.col("_at.expected").alias("expected"), F.col("_at.last").alias("last"), F.lit(0).alias("repeated"),
                     F.array().cast("array<boolean>").alias("marks"))
    folded = computed_once(chunks.join(begins, ["session_id", "_chunk"]), {"_s": F.aggregate("_f", start, step)})
    taken = F.filter("_f", lambda f, k: F.get(F.col("_s.marks"), k))
    room = F.greatest(F.lit(0), F.lit(max_frames) - F.col("_at.taken"))
    whole = F.transform(taken, lambda f: F.struct(*[f[c].alias(c) for c in ("seq", "frame_no", "text", "terminator", "checksum")]))
    parts = folded.select(
        "session_id", "_chunk", F.slice(whole, F.lit(1), room).alias("kept"), F.col("_s.repeated").alias("repeated"),
        F.size("_f").alias("n"), F.size(F.filter(F.col("_s.marks"), lambda m: m)).alias("taken"))
    some = F.when(F.size("kept") > 0, F.struct("_chunk", "kept"))
    total = F.sum("taken").cast("int")
    return parts.groupBy("session_id").agg(
        F.flatten(F.transform(F.array_sort(F.collect_list(some)), lambda p: p["kept"])).alias("accepted"),
        F.sum(F.col("n") - F.col("taken") - F.col("repeated")).cast("int").alias("refused"),
        F.sum("repeated").cast("int").alias("repeated"), total.alias("n_accepted"), (total > max_frames).alias("over_limit"))


def assembled(sessions: DataFrame, ended: DataFrame) -> DataFrame:
    """Message text of each session. COMPLETE when the last accepted frame closed with ETX before the
    end of transmission; otherwise INCOMPLETE_TRANSMISSION (held, never retried). ``ended``: (session_id)."""
    closed = ended.select("session_id").distinct().withColumn("_eot", F.lit(True))
    last = F.try_element_at("accepted", F.lit(-1))
    whole = F.col("_eot").isNotNull() & F.coalesce(last["terminator"] == "ETX", F.lit(False)) & ~F.col("over_limit")
    rows = sessions.join(closed, "session_id", "left")
    return rows.select(
        "session_id", F.array_join(F.transform("accepted", lambda f: f["text"]), "").alias("raw_text"),
        F.col("n_accepted").alias("n_frames"), "refused",
        F.when(whole & (F.size("accepted") > 0), "COMPLETE").otherwise("INCOMPLETE_TRANSMISSION").alias("state"),
    )


def held_incomplete(messages: DataFrame, completed: DataFrame, sender: str = "sender") -> DataFrame:
    """Incomplete transmissions no full message has replaced; queries leave nothing."""
    from .intake import is_query_only

    rows = messages.filter("state = 'INCOMPLETE_TRANSMISSION' AND n_frames > 0")
    rows = rows.filter(~is_query_only(F.col("raw_text")))
    return rows.join(completed, sender, "left_anti") if sender in messages.columns else rows


def records_of(sessions: DataFrame) -> DataFrame:
    """Frames are buffered until an END frame whose last line starts an L record; leftovers are the last record."""
    text = F.transform("accepted", lambda f: F.struct(
        f["text"].alias("text"),
        ((f["terminator"] == "ETX") & F.substring_index(F.regexp_replace(f["text"], "\r+\\z", ""), "\r", -1).startswith("L")
         ).alias("closes")))
    start = F.struct(F.array().cast("array<string>").alias("done"), F.lit("").alias("buffer"))

    def step(acc: Column, f: Column) -> Column:
        joined = F.concat(acc["buffer"], f["text"])
        return F.when(
            f["closes"], F.struct(F.concat(acc["done"], F.array(joined)).alias("done"), F.lit("").alias("buffer"))
        ).otherwise(F.struct(acc["done"].alias("done"), joined.alias("buffer")))

    folded = let(F.aggregate(text, start, step), lambda s: F.concat(
        s["done"], F.when(s["buffer"] != "", F.array(s["buffer"])).otherwise(F.array().cast("array<string>"))))
    return sessions.select("session_id", F.posexplode(folded).alias("record_no", "record"))


def mllp_messages(captured: Column) -> Column:
    """Messages between VT and FS CR in captured text."""
    return F.regexp_extract_all(captured, F.lit("\\x0B([^\\x1C]*)\\x1C\\r"), F.lit(1))
