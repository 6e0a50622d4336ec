"""Per-pixel brute force on small grids, sharing no code with the package."""

import numpy as np

CROSS = ((1, 0), (-1, 0), (0, 1), (0, -1))


def pixels(runs):
    """Rows with y, x0, x1 to a set of (y, x)."""
    return {(r["y"], x) for r in runs for x in range(r["x0"], r["x1"])}


def set_pixels(mask):
    return {(int(y), int(x)) for y, x in zip(*np.nonzero(mask))}


def fit(mask, height, width):
    h, w = mask.shape
    return np.array(
        [[mask[y * h // height, x * w // width] for x in range(width)] for y in range(height)]
    )


def outside(mask):
    framed = np.pad(mask, 1)
    seen, todo = {(0, 0)}, [(0, 0)]
    while todo:
        y, x = todo.pop()
        for dy, dx in CROSS:
            p = (y + dy, x + dx)
            inside = 0 <= p[0] < framed.shape[0] and 0 <= p[1] < framed.shape[1]
            if inside and not framed[p] and p not in seen:
                seen.add(p)
                todo.append(p)
    return {(y - 1, x - 1) for y, x in seen}


def outline(mask):
    out = outside(mask)
    return {p for p in set_pixels(mask) if any((p[0] + dy, p[1] + dx) in out for dy, dx in CROSS)}


def thicken(points, thickness, height, width):
    r = thickness // 2
    disc = [
        (dy, dx)
        for dy in range(-r, r + 1)
        for dx in range(-r, r + 1)
        if 4 * (dy * dy + dx * dx) <= thickness * thickness
    ]
    return {
        (y + dy, x + dx)
        for y, x in points
        for dy, dx in disc
        if 0 <= y + dy < height and 0 <= x + dx < width
    }


def blend(image, mask, drawn, alpha, colour):
    out = image.copy()
    mixed = np.rint(image * (1 - alpha) + np.array(colour) * alpha).clip(0, 255)
    out[mask] = mixed[mask].astype(np.uint8)
    for p in drawn:
        out[p] = colour
    return out
