"""Writers of small files in the recorders' formats."""

from __future__ import annotations

import struct

import numpy as np

from tracemill.sources.edf import ANNOTATIONS


def write_edf(path: str, channels: dict[str, np.ndarray], rate: int, notes=(), start: str = "00.00.00") -> None:
    """Small writer for fixtures: one-second records of 16-bit samples, optional notes."""
    seconds = len(next(iter(channels.values()))) // rate
    note_samples = 60 if notes else 0
    labels = [*channels] + ([ANNOTATIONS] if notes else [])
    counts = [rate] * len(channels) + ([note_samples] if notes else [])
    n = len(labels)
    fields = [(labels, 16), ([""] * n, 80), (["uV"] * n, 8), (["-32768"] * n, 8), (["32767"] * n, 8)]
    fields += [(["-32768"] * n, 8), (["32767"] * n, 8), ([""] * n, 80), ([str(c) for c in counts], 8), ([""] * n, 32)]
    head = f"{'0':<8}{'':<80}{'':<80}{'01.01.20':<8}{start:<8}{256 * (n + 1):<8}"
    head += f"{'EDF+C' if notes else '':<44}{seconds:<8}{1:<8}{n:<4}"
    body = "".join(f"{v:<{width}}" for values, width in fields for v in values)
    with open(path, "wb") as file:
        file.write((head + body).encode("latin-1"))
        for second in range(seconds):
            for values in channels.values():
                file.write(np.asarray(values[second * rate : (second + 1) * rate], "<i2").tobytes())
            if notes:
                text = f"+{second}\x14\x14\x00".encode()
                for onset, duration, labels_at in notes:
                    if int(onset) == second:
                        span = f"\x15{duration}" if duration is not None else ""
                        text += f"+{onset}{span}\x14{chr(20).join(labels_at)}\x14\x00".encode()
                file.write(struct.pack(f"{2 * note_samples}s", text))


def _element(kind: int, body: bytes) -> bytes:
    return struct.pack("<II", kind, len(body)) + body + b"\0" * (-len(body) % 8)


def _matrix(name: str, values: np.ndarray) -> bytes:
    values = np.atleast_2d(np.asarray(values, "<f8"))
    body = _element(6, struct.pack("<II", 6, 0)) + _element(5, np.asarray(values.shape, "<i4").tobytes())
    return body + _element(1, name.encode()) + _element(9, values.tobytes(order="F"))


def write_mat(path: str, name: str, values, compress: bool = False) -> None:
    """One matrix, or a list of matrices as a 1 x n cell array."""
    import zlib

    if isinstance(values, list):
        body = _element(6, struct.pack("<II", 1, 0)) + _element(5, np.asarray([1, len(values)], "<i4").tobytes())
        body += _element(1, name.encode()) + b"".join(_element(14, _matrix("", v)) for v in values)
    else:
        body = _matrix(name, values)
    element = _element(14, body)
    if compress:
        packed = zlib.compress(element)
        element = struct.pack("<II", 15, len(packed)) + packed
    with open(path, "wb") as file:
        file.write(b"MATLAB 5.0".ljust(124) + struct.pack("<HH", 0x0100, 0x4D49) + element)
