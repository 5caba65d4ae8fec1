"""Preparing images and recordings for optional recognisers."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F


def audio_chunks(seconds: Column | str, step: float = 28.0) -> Column:
    """Array of (start, stop) seconds of a recording in pieces of `step`; empty for null and zero lengths."""
    s = (F.col(seconds) if isinstance(seconds, str) else seconds).cast("double")
    n = F.ceil(s / step).cast("int")
    each = F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.struct((i * step).alias("start"), F.least(s, (i + 1) * step).alias("stop")))
    return F.when(n > 0, each).otherwise(F.array().cast("array<struct<start:double,stop:double>>"))


def speech_segments(samples: np.ndarray, rate: int = 16_000, longest: float = 30.0, frame: float = 0.03, quiet: float = 0.3) -> list[tuple[int, int]]:
    """(start, stop) of speech in a recording: loud frames, joined over pauses shorter than `quiet` seconds, cut at the quietest frame where longer than `longest`.

    Loud is above the geometric mean of the quiet and the loud tenth of frames; an even or empty recording has
    no such frames and is cut into steps of 28 seconds instead.
    """
    size, n = int(frame * rate), len(samples) // max(1, int(frame * rate))
    if not n:
        return []
    power = (samples[: n * size].astype(float).reshape(n, size) ** 2).mean(1) + 1e-9
    low, high = np.quantile(power, [0.1, 0.9])
    if high < 4 * low:
        step = int(28 * rate)
        return [(a, min(a + step, len(samples))) for a in range(0, len(samples), step)]
    loud = np.flatnonzero(power > (low * high) ** 0.5)
    parts = np.split(loud, np.flatnonzero(np.diff(loud) * frame > quiet) + 1)
    out, todo = [], [(int(p[0]), int(p[-1]) + 1) for p in parts][::-1]
    while todo:
        a, b = todo.pop()
        if (b - a) * frame <= longest:
            out.append((a * size, min(b * size, len(samples))))
            continue
        most = int(longest / frame)
        at = a + most // 2 + int(np.argmin(power[a + most // 2 : a + most]))
        todo += [(at, b), (a, at)]
    return out


def wav_pieces(raw: bytes, rate: int = 16_000) -> list[bytes]:
    """The speech of a WAV file as pieces of 16-bit mono samples at `rate`."""
    import io
    import wave

    with wave.open(io.BytesIO(raw)) as w:
        width, channels, own = w.getsampwidth(), w.getnchannels(), w.getframerate()
        data = w.readframes(w.getnframes())
    kind = {1: np.uint8, 2: np.int16, 4: np.int32}[width]
    x = np.frombuffer(data, kind).astype(float).reshape(-1, channels).mean(1)
    x = (x - 128) * 256 if width == 1 else x / 65536 if width == 4 else x
    if own != rate and len(x):
        x = np.interp(np.arange(int(len(x) * rate / own)) * own / rate, np.arange(len(x)), x)
    return [x[a:b].astype(np.int16).tobytes() for a, b in speech_segments(x, rate)]


def _window(a: np.ndarray, size: int) -> np.ndarray:
    pad = size // 2
    return np.lib.stride_tricks.sliding_window_view(np.pad(a, pad, mode="edge"), (size, size))


def cleaned_page(pixels: np.ndarray, block: int = 15, below: float = 8.0) -> np.ndarray:
    """A page image ready for recognition: grey, doubled, blurred, black where darker than around, specks opened away."""
    grey = pixels[..., :3] @ [0.299, 0.587, 0.114] if pixels.ndim == 3 else pixels.astype(float)
    large = np.repeat(np.repeat(grey, 2, 0), 2, 1)
    soft = _window(large, 3).mean((2, 3))
    ink = soft < _window(soft, block).mean((2, 3)) - below
    eroded = _window(ink, 2 + 1).all((2, 3))
    opened = _window(eroded, 3).any((2, 3))
    return np.where(opened, 0, 255).astype(np.uint8)
