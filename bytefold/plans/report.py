"""Results as JSON and back, sessions as files."""

from __future__ import annotations

import gzip
import json
import os
from pathlib import Path

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Version of the session file; others are refused.
SESSION_VERSION = 1


def jsonable(value):
    """Bytes as hex, sets sorted, paths as text; all else as it is."""
    if isinstance(value, bytes | bytearray):
        return bytes(value).hex()
    if isinstance(value, set | frozenset):
        return sorted(jsonable(v) for v in value)
    if isinstance(value, Path):
        return str(value)
    if isinstance(value, dict):
        return {str(k): jsonable(v) for k, v in value.items()}
    return [jsonable(v) for v in value] if isinstance(value, list | tuple) else value


def json_rows(df: DataFrame) -> DataFrame:
    """Each row as a JSON text; binary columns as hex."""
    columns: list[Column] = [F.lower(F.hex(c)).alias(c) if t == "binary" else F.col(c) for c, t in df.dtypes]
    return df.select(F.to_json(F.struct(*columns), {"ignoreNullFields": "false"}).alias("value"))


def save_session(snapshot: dict, path: str, compress: bool = True) -> None:
    body = json.dumps(jsonable({"schema_version": SESSION_VERSION} | snapshot)).encode()
    Path(path).parent.mkdir(parents=True, exist_ok=True)
    Path(path).write_bytes(gzip.compress(body) if compress else body)


def load_session(path: str) -> dict:
    """A session file, packed or plain; one of another version is refused."""
    body = Path(path).read_bytes()
    snapshot = json.loads(gzip.decompress(body) if body[:2] == b"\x1f\x8b" else body)
    if snapshot.get("schema_version") != SESSION_VERSION:
        raise ValueError(f"session version {snapshot.get('schema_version')} is unknown")
    return snapshot


def list_sessions(folder: str, suffix: str = ".session") -> list[dict]:
    """Readable sessions of a folder, newest first."""
    out = []
    for p in sorted(Path(folder).glob(f"*{suffix}"), key=os.path.getmtime, reverse=True) if Path(folder).is_dir() else []:
        try:
            out.append({"name": p.name.removesuffix(suffix), "path": str(p), "size": p.stat().st_size} | {k: v for k, v in load_session(str(p)).items() if k in ("session_name", "created_at")})
        except (ValueError, OSError):
            continue
    return out


def delete_session(name: str, folder: str, suffix: str = ".session") -> bool:
    """Delete a session by name; names that leave the folder are refused."""
    target = (Path(folder) / f"{name}{suffix}").resolve()
    if Path(folder).resolve() not in target.parents or not target.is_file():
        return False
    target.unlink()
    return True
