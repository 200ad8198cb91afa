"""Edit distance of word sequences, in a band around the diagonal."""

from __future__ import annotations

from collections.abc import Sequence

# Width of the first band; it doubles until the distance fits or the limit is reached.
FIRST_BAND = 30
# Rows whose places are bits of one integer. Only the stretches under the band are put
# together, so places take room in proportion to the text, however long it is.
_STRETCH = 1 << 10


def edit_distance(
    a: Sequence[int], b: Sequence[int], most: int, at_least: int = 0, exact: bool = True
) -> int | None:
    """The number of words to insert, delete or replace, or None if it is above ``most``.

    ``at_least`` is a bound below that is known already. Without ``exact`` any number from
    the distance up to ``most`` may come back, as soon as one is found.
    """
    delta = abs(len(a) - len(b))
    if delta > most:
        return None
    start, stop = 0, min(len(a), len(b))
    while start < stop and a[start] == b[start]:
        start += 1
    tail = 0
    while tail < stop - start and a[len(a) - 1 - tail] == b[len(b) - 1 - tail]:
        tail += 1
    a, b = a[start : len(a) - tail], b[start : len(b) - tail]
    if not a or not b:
        return max(len(a), len(b))
    places: list[dict[int, int]] = []
    for start in range(0, len(a), _STRETCH):
        marks: dict[int, int] = {}
        for i, word in enumerate(a[start : start + _STRETCH]):
            marks[word] = marks.get(word, 0) | 1 << i
        places.append(marks)
    # Ways out of the band and back have more than 2 * band + 1 - delta edits.
    widest = (most + delta) // 2
    band = min(widest, max(FIRST_BAND, delta, (at_least + delta) // 2))
    while True:
        found = _banded(places, len(a), b, band)
        if found <= 2 * band + 1 - delta or not exact and found <= most:
            return found if found <= most else None
        if band >= widest:
            return None
        band = min(widest, 4 * band)


def _banded(places: list[dict[int, int]], rows: int, b: Sequence[int], band: int) -> int:
    """The least number of edits on ways within the band, with one integer per column of the table.

    Column ``j`` holds rows ``j - band`` to ``j + band``; bit ``p`` of the vertical
    steps is row ``j - band + p``, so the window moves down one row per column.
    """
    width = 2 * band + 1
    full, top = (1 << width) - 1, 1 << (width - 1)
    up, down = full ^ ((1 << band) - 1), 0
    distance = min(rows, band)
    for j, word in enumerate(b, 1):
        shift = j - band - 1
        match = 0
        for n in range(max(shift, 0) // _STRETCH, min(shift + width - 1, rows - 1) // _STRETCH + 1):
            marks = places[n].get(word)
            if marks:
                by = n * _STRETCH - shift
                match |= marks << by if by >= 0 else marks >> -by
        match &= full
        zero = ((((match & up) + up) ^ up) | match | down) & full
        right = down | (full & ~(zero | up))
        left = zero & up
        if j + band <= rows:
            distance += not zero & top
        else:
            # The window reaches below the last row: follow that row instead.
            row = 1 << (rows - j + band) if rows - j + band >= 0 else 0
            distance += bool(right & row)
            distance -= bool(left & row)
        zero >>= 1
        up = left | (full & ~(zero | right))
        down = zero & right
    return distance


def similar(a: Sequence[int], b: Sequence[int], least: float, at_least: int = 0) -> bool:
    """Whether at least this share of the longer sequence stays as it is.

    ``at_least`` edits are known to be needed.
    """
    longer = max(len(a), len(b))
    most = int((1.0 - least) * longer + 1e-9)
    return edit_distance(a, b, most, at_least, exact=False) is not None
