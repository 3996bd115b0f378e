"""Text out of documents, by extension: plain text, office packages, and older office files. Runs in Python workers over (path, content)."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ...runtime import ship
from . import legacy, ooxml, plain

KINDS = {
    ".txt": plain.text, ".md": plain.text, ".markdown": plain.text, ".text": plain.text,
    ".docx": ooxml.docx, ".xlsx": ooxml.xlsx, ".pptx": ooxml.pptx, ".xls": legacy.xls, ".ppt": legacy.ppt,
}


def extracted(name: str, raw: bytes | None) -> tuple[str | None, str | None, str | None]:
    """Text, engine and fault."""
    ext = "." + name.rsplit(".", 1)[-1].lower() if "." in name else ""
    if ext not in KINDS:
        return None, None, f"no reader for {ext or 'files without extension'}"
    engine = KINDS[ext].__module__.rsplit(".", 1)[-1]
    try:
        return KINDS[ext](raw or b""), engine, None
    except Exception as e:  # hostile files fail one by one
        return None, engine, f"{type(e).__name__}: {e}"[:300]


def texts(files: DataFrame, path_col: str = "rel_path", content_col: str = "content") -> DataFrame:
    """path, text, engine and fault of each file."""
    ship(files.sparkSession)

    def run(batches):
        for batch in batches:
            found = [extracted(p or "", c) for p, c in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())]
            yield pa.record_batch([batch.column(0), *[pa.array([f[k] for f in found], pa.string()) for k in range(3)]], names=["path", "text", "engine", "fault"])

    return files.select(F.col(path_col).alias("path"), F.col(content_col).alias("content")).mapInArrow(run, "path string, text string, engine string, fault string")
