"""Land-cover masks from files to classes."""

import struct
import zlib

import numpy as np
from groundphrase.operators import blocks as bl
from groundphrase.sources import readers as rd


def png(a: np.ndarray) -> bytes:
    piece = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
    kind = 0 if a.ndim == 2 else 2
    rows = b"".join(b"\0" + r.tobytes() for r in a)
    return b"\x89PNG\r\n\x1a\n" + piece(b"IHDR", struct.pack(">IIBBBBB", a.shape[1], a.shape[0], 8, kind, 0, 0, 0)) + piece(b"IDAT", zlib.compress(rows)) + piece(b"IEND", b"")


def test_masks_of_files_become_runs(spark, tmp_path):
    r, masks = np.random.default_rng(3), {}
    for split, domain, name in (("Train", "Urban", "1"), ("Val", "Rural", "1"), ("Val", "Rural", "7")):
        folder = tmp_path / split / domain / "masks_png"
        folder.mkdir(parents=True, exist_ok=True)
        masks[f"{split}/{domain}/{name}"] = m = r.integers(0, 3, (int(r.integers(1, 30)), int(r.integers(1, 30))), np.uint8)
        (folder / f"{name}.png").write_bytes(png(m))
        other = tmp_path / split / domain / "images_png"
        other.mkdir(exist_ok=True)
        (other / f"{name}.png").write_bytes(png(m))
    (tmp_path / "Val" / "Rural" / "masks_png" / "8.png").write_bytes(png(np.zeros((2, 2, 3), np.uint8)))
    (tmp_path / "Val" / "Rural" / "masks_png" / "9.png").write_bytes(b"no picture")
    found = rd.read_landcover_masks(spark, str(tmp_path))
    for limit in (1, 40, 1 << 20):
        back = {k: np.full(m.size, 255, np.uint8) for k, m in masks.items()}
        for x in bl.class_runs(bl.to_blocks(found, 1, limit)).collect():
            part = back[x.image_id][x.start : x.start + x.length]
            assert (part == 255).all() and len(part) == x.length
            part[:] = x.class_id
            # a run ends where its class does
            column = masks[x.image_id].T.ravel()
            assert (x.start == 0 or column[x.start - 1] != x.class_id) and (x.start + x.length == len(column) or column[x.start + x.length] != x.class_id)
        for k, m in masks.items():
            assert (back[k] == m.T.ravel()).all()
