"""What a run leaves behind: redacted files, the manifest, the audit, and one bundle."""

from __future__ import annotations

import io
import json
import os
import zipfile

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_files(files: DataFrame, folder: str) -> None:
    """(output_name, content) as files of a folder that all tasks share; each is written beside its place, then renamed, so
    that a task that fails leaves no half of a file."""

    def put(rows) -> None:
        os.makedirs(folder, exist_ok=True)
        for r in rows:
            at = os.path.join(folder, os.path.basename(r.output_name))
            part = f"{at}.{os.getpid()}.partial"
            try:
                with open(part, "wb") as f:
                    f.write(r.content)
                os.replace(part, at)
            finally:
                if os.path.exists(part):
                    os.remove(part)

    files.select("output_name", "content").foreachPartition(put)


def write_audit(findings: DataFrame, path: str) -> None:
    """Leaks of each document as JSON lines."""
    findings.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("part", "ord", "kind", "value"))).alias("leaks")).write.mode("overwrite").json(path)


def bundle(files: list[tuple[str, bytes]], manifest: dict) -> bytes:
    """A zip of an upload's results with manifest.json. For one request, whose size is bounded."""
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for name, data in files:
            z.writestr(name, data)
        z.writestr("manifest.json", json.dumps(manifest, indent=2))
    return out.getvalue()
