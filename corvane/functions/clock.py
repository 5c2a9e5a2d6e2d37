"""Clock texts to seconds. A three-part clock means different things to different writers; each reading has a name."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from corvane.functions.rounding import hundredths, python_round
from corvane.functions.text import ascii_string, find, strip, text


def _parts(c: Column) -> tuple[Column, list[Column]]:
    p = F.split(strip(c), ":")
    return F.size(p), [F.try_element_at(p, F.lit(k)).try_cast("double") for k in (1, 2, 3)]


def hundredths_clock(c: Column) -> Column:
    """MM:SS:cc, MM:SS(.cc), or seconds."""
    n, (a, b, d) = _parts(c)
    return F.when(n == 3, a * 60 + b + d / 100).when(n == 2, a * 60 + b).when(n == 1, a)


def hours_clock(c: Column) -> Column:
    """HH:MM:SS, MM:SS(.cc), or seconds."""
    n, (a, b, d) = _parts(c)
    return F.when(n == 3, a * 3600 + b * 60 + d).when(n == 2, a * 60 + b).when(n == 1, a)


def clock_within(c: Column, duration: Column) -> Column:
    """Of a three-part clock the reading that fits the duration (5 % over is allowed), hours first."""
    h, m, fits = hours_clock(c), hundredths_clock(c), duration * 1.05
    three = (F.size(F.split(strip(c), ":")) == 3) & (duration > 0)
    return F.when(three & (h > fits) & (m <= fits), m).otherwise(h)


def first_clock(c: Column) -> Column:
    """The first M:SS of a text in whole seconds."""
    p = r"(\d{1,2}):(\d{2})(?:\.\d+)?"
    return (find(c, p, 1).cast("double") * 60 + find(c, p, 2).cast("double"))


def all_clocks(c: Column, reader=hundredths_clock) -> Column:
    return F.transform(F.regexp_extract_all(text(c), F.lit(r"\b(\d{1,2}:\d{2}(?:[:.]\d+)?)\b"), F.lit(1)), reader)


def clock_pairs(c: Column) -> Column:
    """Clocks of a text two by two; an odd last one with itself: array<struct<s, e>>."""
    t = all_clocks(c)
    n = F.size(t)
    k = F.sequence(F.lit(0), F.floor((n - 1) / 2).cast("int"))
    at = lambda i: F.element_at(t, i.cast("int"))
    pair = lambda i: F.struct(at(2 * i + 1).alias("s"), at(F.least(2 * i + 2, n)).alias("e"))
    return F.when(n > 0, F.transform(k, pair)).otherwise(F.array().cast("array<struct<s:double,e:double>>"))


def _window(c: Column, pattern: str) -> Column:
    m = [F.regexp_extract_all(text(c), F.lit(pattern), F.lit(g)) for g in (1, 2, 3)]
    at = lambda k: F.try_element_at(m[0], F.lit(k)).cast("double") * 60 + F.try_element_at(m[1], F.lit(k)).cast("double") + F.try_element_at(m[2], F.lit(k)).cast("double") / 100
    return F.when((F.size(m[0]) >= 2) & (at(2) > at(1)), F.struct(at(1).alias("s"), at(2).alias("e")))


def question_window(c: Column) -> Column:
    return _window(c, r"(\d{1,2}):(\d{2})[.:](\d{2})")


def question_window_dot(c: Column) -> Column:
    return _window(c, r"(\d+):(\d+)\.(\d+)")


def answer_window(c: Column, reader=hundredths_clock) -> Column:
    """struct(s, e) of a JSON answer with start and end; null on any failure."""
    s, e = (reader(F.get_json_object(c, f"$.{k}")) for k in ("start", "end"))
    return F.when(s.isNotNull() & e.isNotNull(), F.struct(s.alias("s"), e.alias("e")))


def start_text(c: Column) -> Column:
    return find(c, r'"start"\s*:\s*"([^"]+)"')


def interval_json(c: Column, duration: Column) -> Column:
    """An interval as JSON of two texts: that of a JSON object (or a list's first) with start and end, which is the whole
    text or a ```json fence, else the first two clocks as they stand, else the whole clip."""
    s = strip(text(c))
    body = F.coalesce(find(s, r"(?s)```json\s*(.*?)\s*```"), s)
    whole = F.when(F.try_parse_json(body).isNotNull(), body)
    one = F.when(F.startswith(F.ltrim(whole), F.lit("[")), F.get_json_object(whole, "$[0]")).otherwise(whole)
    keys = F.json_object_keys(one)
    has = F.array_contains(keys, "start") & F.array_contains(keys, "end")
    said = lambda k: F.coalesce(F.initcap(F.when(F.get_json_object(one, f"$.{k}").isin("true", "false"), F.get_json_object(one, f"$.{k}"))), F.get_json_object(one, f"$.{k}"), F.lit("None"))
    clocks = F.regexp_extract_all(s, F.lit(r"(\d{1,2}:\d{2}(?:\.\d+)?)"), F.lit(1))
    last = F.concat(F.format_string("%02d", F.floor(duration / 60).cast("long")), F.lit(":"), hundredths(F.pmod(duration.cast("double"), F.lit(60.0))))
    start = F.when(has, said("start")).when(F.size(clocks) >= 2, F.try_element_at(clocks, F.lit(1))).otherwise("00:00")
    end = F.when(has, said("end")).when(F.size(clocks) >= 2, F.try_element_at(clocks, F.lit(2))).otherwise(last)
    return F.concat(F.lit('{"start": '), ascii_string(start), F.lit(', "end": '), ascii_string(end), F.lit("}"))


def interval_or_clip(c: Column, duration: Column) -> Column:
    """interval_json in seconds: struct(s, e); null where its texts are no clocks."""
    return answer_window(interval_json(c, duration))


def minutes_seconds(c: Column) -> Column:
    n = F.greatest(F.rint(c), F.lit(0.0)).cast("long")
    return F.format_string("%02d:%02d", F.floor(n / 60), n % 60)


def minutes_hundredths(c: Column) -> Column:
    m = F.floor(c.cast("long") / 60)
    return F.concat(F.format_string("%02d", m), F.lit(":"), hundredths(c - m * 60))


def clip_seconds(frames: Column, fps: Column) -> Column:
    return frames / F.when(fps > 0, fps).otherwise(30.0)


def seconds_target(c: Column, duration: Column) -> Column:
    """A JSON interval answer as JSON of two numbers of seconds, two digits, read by the clip's duration."""
    s, e = (python_round(clock_within(F.get_json_object(c, f"$.{k}"), duration), 2) for k in ("start", "end"))
    return F.concat(F.lit('{"start": '), s.cast("string"), F.lit(', "end": '), e.cast("string"), F.lit("}"))
