"""Frame-index arithmetic on arrays, without rows per frame."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from corvane.functions.rounding import python_round

# Fixed values.
N_FRAMES, DENSE_MAIN, DENSE_LOCAL, DENSE_CAUSAL, BUFFER = 32, 16, 12, 8, 1.0
REPEATS = {"S": 3, "A": 2, "B": 1}


def let(x: Column, f) -> Column:
    """f of a value that is computed once, though f uses it often or inside a lambda."""
    return F.transform(F.array(x), f)[0]


def _none() -> Column:
    return F.array().cast("array<bigint>")


def frame_at(seconds: Column, fps: Column, total: Column) -> Column:
    """Half to even, within the clip."""
    return F.greatest(F.lit(0), F.least(total - 1, F.rint(seconds * fps).cast("long"))).cast("long")


def spread(first: Column, last: Column, n: Column) -> Column:
    """n evenly spaced integers from first to last, cut off to integers; n >= 1."""

    def run(v: Column) -> Column:
        a, z, k = v["a"], v["z"], v["n"]
        step = (z - a) / F.greatest(k - 1, F.lit(1))
        return F.transform(F.sequence(F.lit(0).cast("long"), k - 1), lambda i: F.when(k == 1, a).when(i == k - 1, z).otherwise(F.floor(a + i * step)).cast("long"))

    return let(F.struct(first.cast("long").alias("a"), last.cast("long").alias("z"), n.cast("long").alias("n")), run)


def dense(first: Column, last: Column, n, total: Column) -> Column:
    a = F.greatest(F.lit(0), first)
    ends = F.struct(a.cast("long").alias("a"), F.greatest(a, F.least(total - 1, last)).cast("long").alias("z"))
    return let(ends, lambda v: F.sort_array(F.array_distinct(spread(v["a"], v["z"], F.least(F.lit(n), v["z"] - v["a"] + 1)))))


def covered(total: Column, closed: Column) -> Column:
    """struct(parts, free) of closed intervals (array<struct<s, e>>; they may overlap, touch, repeat and leave the clip):
    each interval's frames that no earlier one has, as (how many free frames lie before them, how many they are), and
    how many frames of the clip are free. Work and memory follow the intervals, not the clip's length."""
    last = (total - 1).cast("long")
    clipped = F.transform(closed, lambda x: F.struct(F.greatest(F.lit(0).cast("long"), x["s"].cast("long")).alias("s"), F.least(last, x["e"].cast("long")).alias("e")))
    start = F.struct(F.lit(-1).cast("long").alias("z"), F.lit(0).cast("long").alias("n"), F.array().cast("array<struct<before:bigint,n:bigint>>").alias("parts"))

    def add(acc: Column, x: Column) -> Column:
        def run(v: Column) -> Column:
            part = F.struct((v["first"] - acc["n"]).alias("before"), v["n"].alias("n"))
            grown = F.struct(x["e"].alias("z"), (acc["n"] + v["n"]).alias("n"), F.array_append(acc["parts"], part).alias("parts"))
            return F.when(v["n"] > 0, grown).otherwise(acc)

        first = F.greatest(x["s"], acc["z"] + 1)
        return let(F.struct(first.alias("first"), (x["e"] - first + 1).alias("n")), run)

    def end(acc: Column) -> Column:
        return F.struct(acc["parts"].alias("parts"), F.greatest(F.lit(0).cast("long"), total.cast("long") - acc["n"]).alias("free"))

    return F.aggregate(F.sort_array(clipped), start, add, end)


def nth_free(parts: Column, k: Column) -> Column:
    """The k-th frame (from 0) in none of the intervals: k and the lengths of the parts with at most k free frames before."""
    return F.aggregate(parts, k.cast("long"), lambda at, x: F.when(x["before"] <= k, at + x["n"]).otherwise(at))


def uniform_outside(total: Column, closed: Column, n: Column) -> Column:
    """n frames (all, if there are fewer) evenly over those in none of the closed intervals."""

    def run(v: Column) -> Column:
        count = F.least(v["n"].cast("long"), v["c"]["free"])
        at = spread(F.lit(0), v["c"]["free"] - 1, count)
        return F.when(count > 0, F.array_distinct(F.transform(at, lambda k: nth_free(v["c"]["parts"], k)))).otherwise(_none())

    return let(F.struct(covered(total, closed).alias("c"), n.alias("n")), run)


def _points(idx: Column) -> Column:
    return F.transform(idx, lambda i: F.struct(i.alias("s"), i.alias("e")))


def uniform(total: Column, n: Column) -> Column:
    return F.when(total > 0, F.array_distinct(spread(F.lit(0).cast("long"), total - 1, F.least(n, total)))).otherwise(_none())


def uniform_rounded(total: Column, n: int) -> Column:
    every = F.sequence(F.lit(0).cast("long"), total - 1)
    some = F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.rint(i * (total - 1) / (n - 1)).cast("long"))
    return F.when(total <= n, every).otherwise(some)


def uniform_even(total: Column, n: int) -> Column:
    """Even count; repeats if the clip is short. An odd n keeps its own divisor."""
    return F.transform(F.sequence(F.lit(0), F.lit(n + n % 2 - 1)), lambda i: F.floor(i * total / n).cast("long"))


def resize(idx: Column, total: Column, n: int) -> Column:
    """Exactly n (made even) indices where the clip has them: every k-th of too many, filled up evenly if too few."""
    n += n % 2

    def cut(have: Column) -> Column:
        fewer = F.array_distinct(F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.element_at(have, (F.floor(i * F.size(have) / n) + 1).cast("int"))))
        return F.when(F.size(have) > n, fewer).otherwise(have)

    def fill(have: Column) -> Column:
        return F.slice(F.sort_array(F.array_union(have, uniform_outside(total, _points(have), F.lit(n) - F.size(have)))), 1, n)

    return let(let(F.sort_array(F.array_distinct(idx.cast("array<bigint>"))), cut), fill)


def span(window: Column, fps: Column, total: Column) -> Column:
    """The window with a second around it, in frames."""
    return F.struct(frame_at(F.greatest(F.lit(0.0), window["s"] - BUFFER), fps, total).alias("s"), frame_at(window["e"] + BUFFER, fps, total).alias("e"))


def plan(task: Column, question_pairs: Column, answer_window: Column, total: Column, fps: Column) -> Column:
    """The task's plan: dense around the window it names, evenly over the rest; evenly over all without a window."""

    def around(window: Column, n: int) -> Column:
        def run(s: Column) -> Column:
            return let(dense(s["s"], s["e"], n, total), lambda d: F.sort_array(F.array_union(d, uniform_outside(total, F.array(s), F.lit(N_FRAMES) - F.size(d)))))

        return let(span(window, fps, total), run)

    first = F.try_element_at(question_pairs, F.lit(1))

    def around_all(two: Column) -> Column:
        parts = F.flatten(F.transform(two, lambda s: dense(s["s"], s["e"], DENSE_CAUSAL, total)))
        return let(parts, lambda d: F.sort_array(F.array_union(d, uniform_outside(total, two, F.lit(N_FRAMES) - F.size(d)))))

    causal = let(F.transform(F.slice(question_pairs, 1, 2), lambda w: span(w, fps, total)), around_all)
    return (
        F.when((task == "temporal_localization") & answer_window.isNotNull(), around(answer_window, DENSE_LOCAL))
        .when(task.isin("temporal_description", "mcq", "mcq_openended") & first.isNotNull(), around(first, DENSE_MAIN))
        .when((task == "causal_linkage") & first.isNotNull(), causal)
        .otherwise(uniform(total, F.lit(N_FRAMES)))
    )


def filled(idx: Column, total: Column) -> Column:
    """Filled to N_FRAMES evenly from the frames that aren't in idx, then cut."""
    more = lambda have: F.array_union(have, uniform_outside(total, _points(have), F.lit(N_FRAMES) - F.size(have)))
    return let(idx, lambda have: F.slice(F.sort_array(F.when(F.size(have) < N_FRAMES, more(have)).otherwise(have)), 1, N_FRAMES))


def adaptive_count(duration: Column, fps: Column, cap: int, floor: int = 8) -> Column:
    n = F.greatest(F.lit(floor), F.least(F.lit(cap), F.floor(duration * fps))).cast("long")
    return n + n % 2


def window_frames(start: Column, end: Column, fps: Column, total: Column, n: int, speed: Column | None = None) -> Column:
    """struct(idx, local, frames, fps): an even number of frames, at most n, spread over a window by rounding half to
    even; their place counted from the window's start; how many frames the window has, and the rate a viewer is told,
    scaled by the speed. The window's ends are cut off to whole frames, and the frame at its end is left out."""
    rate = fps.cast("double")
    first = F.greatest(F.lit(0).cast("long"), (start * rate).cast("long"))
    last = F.least((total - 1).cast("long"), F.greatest(F.lit(1).cast("long"), (end * rate).cast("long") - 1))

    def run(v: Column) -> Column:
        a, z = v["a"], v["z"]
        count = F.least(F.lit(n).cast("long"), F.greatest(F.lit(2).cast("long"), z - a + 1))
        count = count - count % 2
        step = (z - a) / (count - 1)
        at = F.transform(F.sequence(F.lit(0).cast("long"), count - 1), lambda i: F.when(i == count - 1, z).otherwise(F.rint(i * step + a).cast("long")))
        told = rate * (F.lit(1.0) if speed is None else F.coalesce(speed, F.lit(1.0)))
        return F.struct(at.alias("idx"), F.transform(at, lambda x: x - a).alias("local"), F.greatest(z - a + 1, F.element_at(at, -1) - a + 1).alias("frames"), told.alias("fps"))

    return let(F.struct(first.alias("a"), last.alias("z")), run)


def fit_size(width: Column, height: Column, longest: int) -> Column:
    """Never larger; each side a multiple of 32, at least 32."""
    s = F.least(F.lit(1.0), F.lit(float(longest)) / F.greatest(width, height))
    side = lambda x: F.greatest(F.lit(32), F.rint(x * s / 32).cast("int") * 32)
    return F.struct(side(width).alias("w"), side(height).alias("h"))


# --- grids

def shown_grid(idx: Column, fps: Column) -> Column:
    return F.sort_array(F.array_distinct(F.transform(idx, lambda i: python_round(i / F.when(fps > 0, fps).otherwise(30.0), 1))))


def _after(grid: Column, s: Column, e: Column) -> Column:
    """If the end is not behind the start, the next grid point is the end."""
    nxt = F.coalesce(F.array_min(F.filter(grid, lambda g: g > s)), F.array_max(grid))
    return F.struct(s.alias("s"), F.when(e <= s, nxt).otherwise(e).alias("e"))


def snap_outward(grid: Column, start: Column, end: Column) -> Column:
    s = F.coalesce(F.array_max(F.filter(grid, lambda g: g <= start + 1e-6)), F.array_min(grid))
    e = F.coalesce(F.array_min(F.filter(grid, lambda g: g >= end - 1e-6)), F.array_max(grid))
    return _after(grid, s, e)


def nearest(keys: Column, x: Column) -> Column:
    """The nearest key; the smaller of two equally near."""
    return F.array_min(F.transform(keys, lambda k: F.struct(F.abs(k - x).alias("d"), k.alias("k"))))["k"]


def snap_nearest(grid: Column, start: Column, end: Column) -> Column:
    return _after(grid, nearest(grid, start), nearest(grid, end))


# --- boxes

def scaled_boxes(boxes: Column, width: Column, height: Column, brightness: Column, classes, least: float = 0.25, dark: float = 12.0, most: int = 20) -> Column:
    """Boxes of a frame scaled to 0-1: none in a dark or overfull frame; only allowed classes with enough confidence."""
    ok = F.filter(boxes, lambda b: (b["conf"] >= least) & b["cls"].isin(*classes))
    small = F.transform(ok, lambda b: F.struct(b["cls"].alias("cls"), python_round(b["x1"] / width, 4).alias("x1"), python_round(b["y1"] / height, 4).alias("y1"), python_round(b["x2"] / width, 4).alias("x2"), python_round(b["y2"] / height, 4).alias("y2"), python_round(b["conf"], 3).alias("conf")))
    return F.when((brightness < dark) | (F.size(ok) > most), F.slice(small, 1, 0)).otherwise(small)


def pixel_boxes(boxes: Column, width: Column, height: Column) -> Column:
    return F.transform(boxes, lambda b: F.struct(b["cls"].alias("cls"), F.floor(b["x1"] * width).cast("int").alias("x1"), F.floor(b["y1"] * height).cast("int").alias("y1"), F.floor(b["x2"] * width).cast("int").alias("x2"), F.floor(b["y2"] * height).cast("int").alias("y2")))


# Colours (red, green, blue) by class, of classes without one, and the colours that corrupt boxes take.
COLOURS = {0: (0, 255, 0), 1: (0, 255, 0), 2: (0, 0, 255), 3: (255, 165, 0), 5: (0, 0, 255), 7: (0, 0, 255), 9: (255, 255, 0), 11: (255, 255, 0)}
OTHER_COLOUR = (200, 200, 200)
PALETTE = ((0, 255, 0), (0, 0, 255), (255, 165, 0), (255, 255, 0))


def _colour(rgb) -> Column:
    return F.array(*map(F.lit, rgb))


def box_colour(cls: Column, mode: Column, draw: Column) -> Column:
    """The class's colour; in mode corrupt that of a draw from 0 (included) to 1."""
    known = F.create_map(*(x for k, rgb in COLOURS.items() for x in (F.lit(k), _colour(rgb))))
    drawn = F.element_at(F.array(*map(_colour, PALETTE)), F.floor(draw * len(PALETTE)).cast("int") + 1)
    return F.when(mode == "corrupt", drawn).otherwise(F.coalesce(F.try_element_at(known, cls.cast("int")), _colour(OTHER_COLOUR)))


def cue_mode(draw: Column, off: float = 0.30, corrupt: float = 0.15) -> Column:
    """off, correct or corrupt, by a draw from 0 (included) to 1."""
    return F.when(draw < off, "off").when(draw > 1.0 - corrupt, "corrupt").otherwise("correct")


def draw_of(*key: Column, seed: int = 0) -> Column:
    """A draw that belongs to a key, the same in every run and partitioning."""
    return F.pmod(F.xxhash64(*key, F.lit(seed)), F.lit(1 << 30)) / float(1 << 30)


def timed_prompt(idx: Column, fps: Column, question: Column) -> Column:
    from corvane.functions.clock import minutes_hundredths

    # The wording of the header and of the marks is a training format.
    marks = F.transform(idx, lambda i: F.concat(F.lit("[t="), minutes_hundredths(i / fps), F.lit("] <image>")))
    length = F.when(F.size(idx) > 0, F.try_element_at(idx, F.lit(-1)) / fps).otherwise(0.0)
    header = F.concat(F.lit("Video duration: "), minutes_hundredths(length), F.lit(". "), F.size(idx).cast("string"), F.lit(" frames sampled:\n"))
    return F.concat(header, F.array_join(marks, "\n"), F.lit("\n"), question)
