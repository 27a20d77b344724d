"""Reading order and grouping on a page: recursion and running membership, so one vectorised group a page."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from statistics import median

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

PAGE = ["document_id", "page_number"]
# Shares and heights of the banded order.
ROW_SHARE, TALL, CUT_GAP, COLUMN_SHARE = 0.5, 3.0, 0.4, 0.7


def _parts(low: np.ndarray, high: np.ndarray, gap: float) -> list[np.ndarray]:
    """Interval sweep: positions by their low end, parted where the next begins ``gap`` or more after all before have ended."""
    by = np.argsort(low, kind="stable")
    ended = np.maximum.accumulate(high[by])
    return np.split(by, np.flatnonzero(low[by][1:] - ended[:-1] >= gap) + 1)


def cut_order(boxes: list[tuple]) -> list[int]:
    """Recursive cut at the widest gap; a column cut only if strictly wider than the widest row gap. Boxes without a gap stay in the
    order given."""
    b = np.array(boxes, float).reshape(-1, 4)
    out, todo = [], [np.arange(len(b))]
    while todo:
        ids = todo.pop()
        best = (0.0, None, None)
        for axis in (1, 0) if len(ids) > 1 else ():
            low, high = b[ids, axis], b[ids, axis + 2]
            by = np.argsort(low, kind="stable")
            gaps = low[by][1:] - np.maximum.accumulate(high[by])[:-1]
            at = int(gaps.argmax())
            if gaps[at] > best[0]:
                best = (gaps[at], axis, low[by][at + 1])
        if best[1] is None:
            out += ids.tolist()
        else:
            after = b[ids, best[1]] >= best[2]
            todo += [ids[after], ids[~after]]
    return out


def page_rows(boxes: list[tuple], ids: list[int], height: float, tall: bool = True) -> list[list[int]]:
    """Seeded rows: each box in turn from the top, unless it has a row, starts one with all boxes still without a row that overlap it by
    half of the smaller height; with ``tall``, a box above three median heights is a row of its own. Rows from the top, from the left inside."""
    b, ids = np.array(boxes, float).reshape(-1, 4), np.array(ids, int)
    top, bottom = b[ids, 1], b[ids, 3]
    size = bottom - top
    alone = (size > TALL * height) & bool(tall and height)
    number, rows = np.full(len(ids), -1), 0
    for i in np.lexsort((ids, top)):
        if number[i] < 0:
            shared, least = np.minimum(bottom, bottom[i]) - np.maximum(top, top[i]), np.minimum(size, size[i])
            near = (least > 0) & (shared >= ROW_SHARE * least) & ~alone & ~alone[i]
            near[i] = True
            number[near & (number < 0)] = rows
            rows += 1
    first = np.full(rows, np.inf)
    np.minimum.at(first, number, top)
    place = np.argsort(np.argsort(first, kind="stable"), kind="stable")
    order = np.lexsort((b[ids, 0], place[number]))
    return [x.tolist() for x in np.split(ids[order], np.flatnonzero(np.diff(place[number][order])) + 1)] if len(ids) else []


def banded_order(boxes: list[tuple]) -> list[int]:
    """Bands from the top first, in which a tall box counts three median heights; a band without bands is read by columns if each of
    them spans most of its height, else row by row. Gaps count from 0.4 median heights on."""
    b = np.array(boxes, float).reshape(-1, 4)
    height = float(np.median(b[:, 3] - b[:, 1])) if len(b) else 0.0
    out, todo = [], [np.arange(len(b))] if len(b) else []
    while todo:
        ids = todo.pop()
        left, top, right, bottom = b[ids].T
        bands = _parts(top, np.minimum(bottom, top + TALL * height) if height else bottom, CUT_GAP * height)
        if len(bands) == 1:
            columns = _parts(left, right, CUT_GAP * height)
            whole = bottom.max() - top.min()
            wide = whole > 0 and all(bottom[c].max() - top[c].min() >= COLUMN_SHARE * whole for c in columns)
            if len(columns) == 1 or not wide:
                out += [i for row in page_rows(boxes, ids, height, tall=False) for i in row]
                continue
            bands = columns
        todo += [ids[part] for part in reversed(bands)]
    return out


def text_lines(boxes: list[tuple]) -> list[int]:
    """A line number for every word: by centre from the top, a word joins the last line if its centre is within half the
    median height of the line's running mean; lines part where the gap in x exceeds the median height."""
    if not boxes:
        return []
    height = median(b[3] - b[1] for b in boxes)
    centre = lambda i: (boxes[i][1] + boxes[i][3]) / 2
    lines: list[list[int]] = []
    for i in sorted(range(len(boxes)), key=lambda i: (centre(i), boxes[i][0], i)):
        if lines and abs(centre(i) - sum(map(centre, lines[-1])) / len(lines[-1])) < height / 2:
            lines[-1].append(i)
        else:
            lines.append([i])
    out, n = [0] * len(boxes), 0
    for line in lines:
        n += 1
        last = None
        for i in sorted(line, key=lambda i: (boxes[i][0], i)):
            if last is not None and boxes[i][0] - last > height:
                n += 1
            last = boxes[i][2] if last is None else max(last, boxes[i][2])
            out[i] = n
    return out


def suppressed(boxes: list[tuple], scores: list[float], most: float = 0.5) -> list[bool]:
    """Greedy: by falling score, a box that overlaps one already kept (IoU of ``most`` or more) is dropped; ties by position."""
    kept: list[int] = []
    drop = [True] * len(boxes)
    for i in sorted(range(len(boxes)), key=lambda i: (-scores[i], i)):
        a = boxes[i]

        def over(j):
            b = boxes[j]
            inside = max(0, min(a[2], b[2]) - max(a[0], b[0])) * max(0, min(a[3], b[3]) - max(a[1], b[1]))
            whole = (a[2] - a[0]) * (a[3] - a[1]) + (b[2] - b[0]) * (b[3] - b[1]) - inside
            return whole > 0 and inside / whole >= most

        if not any(map(over, kept)):
            kept.append(i)
            drop[i] = False
    return drop


def spanning(boxes: list[tuple]) -> list[bool]:
    """Boxes over two or more others, each below 0.6 of its area and overlapped by 0.8 of the smaller: one control around several."""
    size = [(b[2] - b[0]) * (b[3] - b[1]) for b in boxes]

    def over(a, b):
        inside = max(0, min(a[2], b[2]) - max(a[0], b[0])) * max(0, min(a[3], b[3]) - max(a[1], b[1]))
        return inside

    return [sum(j != i and size[j] < 0.6 * size[i] and min(size[i], size[j]) > 0 and over(boxes[i], boxes[j]) / min(size[i], size[j]) >= 0.8 for j in range(len(boxes))) >= 2 for i in range(len(boxes))]


def claimed(options: list[tuple], targets: list[tuple]) -> list[int | None]:
    """options and targets: (label, left, top, right, bottom). Options by top and left each take the nearest target of their label
    that none took before; ties to the first target."""
    centre = lambda b: ((b[1] + b[3]) / 2, (b[2] + b[4]) / 2)
    taken, out = set(), [None] * len(options)
    for i in sorted(range(len(options)), key=lambda i: (options[i][2], options[i][1], i)):
        x, y = centre(options[i])
        free = [j for j in range(len(targets)) if j not in taken and targets[j][0] == options[i][0]]
        if free:
            out[i] = min(free, key=lambda j: ((centre(targets[j])[0] - x) ** 2 + (centre(targets[j])[1] - y) ** 2, j))
            taken.add(out[i])
    return out


def owned_rows(rows: list[tuple[int, set]]) -> list[int]:
    """rows: (options, child ids). By most options, a row is chosen if no chosen one shares a child; ties to the first."""
    used: set = set()
    out = []
    for i in sorted(range(len(rows)), key=lambda i: (-rows[i][0], i)):
        if not rows[i][1] & used:
            out.append(i)
            used |= rows[i][1]
    return sorted(out)


def inline_runs(regions: list[tuple]) -> list[int]:
    """regions in reading order: (left, top, right, bottom, kind, inline). A run number each: neighbours go on in one line where they
    overlap by 0.4 of the smaller height and the second starts right of the first, at most three heights on; a control may join any kind."""
    out, run = [], 0
    for i, b in enumerate(regions):
        if i:
            a = regions[i - 1]
            smaller = min(a[3] - a[1], b[3] - b[1])
            level = smaller > 0 and (min(a[3], b[3]) - max(a[1], b[1])) / smaller >= 0.4
            kinds = a[4] == b[4] or "control" in (a[4], b[4])
            gap = b[0] - a[2]
            if not (a[5] and b[5] and kinds and level and b[0] > a[0] and -smaller <= gap <= 3 * smaller):
                run += 1
        out.append(run)
    return out


def paragraphs(boxes: list[tuple], lines: list[int]) -> list[int]:
    """A paragraph number for every word: a line goes on in the paragraph if it starts within a median height below the last line and
    shares x with it."""
    height = median(b[3] - b[1] for b in boxes) if boxes else 0
    hull: dict[int, list] = {}
    for b, n in zip(boxes, lines):
        h = hull.setdefault(n, list(b))
        h[:] = [min(h[0], b[0]), min(h[1], b[1]), max(h[2], b[2]), max(h[3], b[3])]
    number, last, n = {}, None, 0
    for k in sorted(hull, key=lambda k: (hull[k][1], hull[k][0], k)):
        h = hull[k]
        if last is None or h[1] - last[3] > height or min(h[2], last[2]) <= max(h[0], last[0]):
            n += 1
        number[k], last = n, h
    return [number[k] for k in lines]


def with_columns(regions: DataFrame, columns: dict[str, tuple[str, Callable]]) -> DataFrame:
    """Columns {name: (type, f(page, boxes))} of every page in one pass: pages are dealt by hash and sorted, and a task walks through its
    pages batch by batch, so that small pages cost neither a group nor an exchange each. A page's rows come by region_id."""
    names = regions.columns
    schema = regions.schema.simpleString().removeprefix("struct<").removesuffix(">")
    boxed = [*map(names.index, ("left", "top", "right", "bottom"))]

    def pages(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[pd.DataFrame] = []
        for batch in batches:
            if batch.empty:
                continue
            new = np.flatnonzero((batch[PAGE] != batch[PAGE].shift()).any(axis=1).to_numpy())
            if held and (held[0][PAGE].iloc[0] == batch[PAGE].iloc[0]).all():
                new = new[1:]
            for part in np.split(np.arange(len(batch)), new):
                if len(part) and part[0] in new and held:
                    yield pd.concat(held, ignore_index=True)
                    held = []
                if len(part):
                    held.append(batch.iloc[part])
        if held:
            yield pd.concat(held, ignore_index=True)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ready, n = [], 0
        for page in pages(batches):
            boxes = list(zip(*(page.iloc[:, i].tolist() for i in boxed)))
            ready.append(page.assign(**{c: f(page, boxes) for c, (_, f) in columns.items()}))
            n += len(page)
            if n >= 5000:
                yield pd.concat(ready, ignore_index=True)
                ready, n = [], 0
        if ready:
            yield pd.concat(ready, ignore_index=True)

    dealt = regions.repartition(*PAGE).sortWithinPartitions(*PAGE, "region_id")
    return dealt.mapInPandas(run, schema + "".join(f",{c}:{kind}" for c, (kind, _) in columns.items()))


def _by_page(regions: DataFrame, column: str, kind: str, f) -> DataFrame:
    return with_columns(regions, {column: (kind, f)})


def _ranks(order: list[int]) -> list[int]:
    out = [0] * len(order)
    for n, i in enumerate(order, 1):
        out[i] = n
    return out


def with_cut_order(regions: DataFrame) -> DataFrame:
    return _by_page(regions, "cut_rank", "int", lambda _, b: _ranks(cut_order(b)))


def with_banded_order(regions: DataFrame) -> DataFrame:
    return _by_page(regions, "banded_rank", "int", lambda _, b: _ranks(banded_order(b)))


def with_orders(regions: DataFrame) -> DataFrame:
    """Both orders and the lines, in one pass."""
    return with_columns(regions, {"cut_rank": ("int", lambda _, b: _ranks(cut_order(b))), "banded_rank": ("int", lambda _, b: _ranks(banded_order(b))), "line": ("int", lambda _, b: text_lines(b))})


def with_lines(words: DataFrame) -> DataFrame:
    return _by_page(words, "line", "int", lambda _, b: text_lines(b))


def without_overlaps(detections: DataFrame, most: float = 0.5) -> DataFrame:
    """detections with a column score; ties by region_id."""
    return _by_page(detections, "dropped", "boolean", lambda p, b: suppressed(b, p.score.tolist(), most)).filter("not dropped").drop("dropped")


def with_paragraphs(words: DataFrame) -> DataFrame:
    return _by_page(words, "paragraph", "int", lambda _, b: paragraphs(b, text_lines(b)))


def _row_numbers(_, boxes):
    out = [0] * len(boxes)
    for n, row in enumerate(page_rows(boxes, range(len(boxes)), median(b[3] - b[1] for b in boxes)), 1):
        for i in row:
            out[i] = n
    return out


def with_rows(regions: DataFrame) -> DataFrame:
    """Row numbers of seeded rows with the rule for tall boxes."""
    return _by_page(regions, "row", "int", _row_numbers)


def resolved_controls(detections: DataFrame, most: float = 0.5) -> DataFrame:
    """Detections without overlaps and without boxes around several kept ones."""
    kept = without_overlaps(detections, most)
    return _by_page(kept, "spans", "boolean", lambda _, b: spanning(b)).filter("not spans").drop("spans")


def _runs(page, boxes):
    order = page.reading_order.argsort(kind="stable").tolist()
    found = inline_runs([(*boxes[i], page.kind[i], bool(page.inline[i])) for i in order])
    out = [0] * len(boxes)
    for i, r in zip(order, found):
        out[i] = r
    return out


def with_inline_runs(regions: DataFrame) -> DataFrame:
    """regions with kind, inline and reading_order; the run in reading order."""
    return _by_page(regions, "run", "int", _runs)


def _form_ranks(page, boxes):
    groups: dict = {}
    for i, c in enumerate(page.container_id):
        groups.setdefault(("r", i) if c is None or c != c else ("c", c), []).append(i)
    keys = list(groups)
    hulls = [(min(boxes[i][0] for i in g), min(boxes[i][1] for i in g), max(boxes[i][2] for i in g), max(boxes[i][3] for i in g)) for g in groups.values()]
    height = median(b[3] - b[1] for b in boxes)
    return _ranks([i for k in cut_order(hulls) for row in page_rows(boxes, groups[keys[k]], height) for i in row])


def form_order(regions: DataFrame) -> DataFrame:
    """regions with container_id (null: none). The regions of a container are one block of its hull: blocks by the cut, inside a block
    row by row."""
    return _by_page(regions, "form_rank", "int", _form_ranks)


def _separated_ranks(page, boxes, at: str = "separator"):
    x = page[at].iloc[0]
    if x is None or x != x:
        return _ranks(cut_order(boxes))
    left = [i for i, b in enumerate(boxes) if b[2] <= x]
    right = [i for i, b in enumerate(boxes) if b[0] >= x]
    across = [i for i, b in enumerate(boxes) if b[0] < x < b[2]]
    top = min((boxes[i][1] for i in left + right), default=0)
    parts = ([i for i in across if boxes[i][1] < top], left, right, [i for i in across if boxes[i][1] >= top])
    return _ranks([p[k] for p in parts for k in cut_order([boxes[i] for i in p])])


def separated_order(regions: DataFrame, at: str = "separator") -> DataFrame:
    """regions with the x of their page's vertical separator (null: none): what lies across it above the first column box comes first,
    then the left, then the right, then the rest, each by the cut."""
    return _by_page(regions, "separated_rank", "int", lambda p, b: _separated_ranks(p, b, at))


def with_structures(regions: DataFrame) -> DataFrame:
    """Paragraphs, rows, inline runs, the order with forms kept whole and the order by separators, in one pass."""
    return with_columns(regions, {
        "paragraph": ("int", lambda _, b: paragraphs(b, text_lines(b))), "row": ("int", _row_numbers), "run": ("int", _runs),
        "form_rank": ("int", _form_ranks), "separated_rank": ("int", _separated_ranks),
    })


def registered(pairs: list[tuple], crop: tuple) -> tuple | None:
    """pairs: a reply's box on the crop's grid of 0 to 1000 and the detected box (left, top, right, bottom each) of the same unique label.
    (scale x, offset x, scale y, offset y) of the least squares through the centres, if three or more pairs rise on both axes, the grid
    misses them by more than half a box, the fit by two at most and by less than the grid; medians are the upper ones."""
    if len(pairs) < 3:
        return None
    centre = lambda b: ((b[0] + b[2]) / 2, (b[1] + b[3]) / 2)
    seen, real = [centre(a) for a, _ in pairs], [centre(b) for _, b in pairs]
    line = []
    for axis in (0, 1):
        xs, ys = [p[axis] for p in seen], [p[axis] for p in real]
        mx, my = sum(xs) / len(xs), sum(ys) / len(ys)
        spread = sum((x - mx) ** 2 for x in xs)
        scale = sum((x - mx) * (y - my) for x, y in zip(xs, ys)) / spread if spread else 0
        if scale <= 0:
            return None
        line += [scale, my - scale * mx]
    size = (crop[2] - crop[0], crop[3] - crop[1])

    def miss(place):
        off = [max(abs(place(p)[k] - q[k]) / (b[k + 2] - b[k]) for k in (0, 1)) for p, q, (_, b) in zip(seen, real, pairs)]
        return sorted(off)[len(off) // 2]

    grid = miss(lambda p: tuple(crop[k] + p[k] * size[k] / 1000 for k in (0, 1)))
    fit = miss(lambda p: (line[0] * p[0] + line[1], line[2] * p[1] + line[3]))
    return None if grid <= 0.5 or fit > 2 or fit >= grid else tuple(line)
