"""Library descriptions in YAML as layout rows."""

from __future__ import annotations

import os
import re

#: Flow cell and index regions that are left out; kinds of region that are the read itself.
DROPPED = {"illumina_p5", "illumina_p7", "index5", "index7"}
PAYLOAD = {"cdna", "gdna", "dna", "rna", "atac", "protein", "crispr", "tag", "hic", "methyl", "sgrna_target"}
#: Parts of file names of well-known lists and their keys, the more specific first.
KNOWN_LISTS = {
    "3m-february-2018": "10x_3v3", "3m-3pgex": "10x_3v4", "3m-5pgex": "10x_5v3", "737k-august-2016": "10x_3v2",
    "visium-v5": "10x_Vis_V5", "visium-v4": "10x_Vis_V4", "visium-v3": "10x_Vis_V3", "visium-v2": "10x_Vis_V2", "visium-v1": "10x_Vis_V1",
}


def is_seqspec(path: str) -> bool:
    ext = os.path.splitext(path)[1].lower()
    if ext in (".yaml", ".yml", ".csv", ".tsv", ".txt"):
        return ext in (".yaml", ".yml")
    try:
        with open(path, errors="replace") as f:
            return re.search("seqspec_version|library_spec|assay_spec", f.read(8192)) is not None
    except OSError:
        return False


def _text(node: dict, key: str) -> str:
    value = node.get(key)
    return "" if value is None else str(value).lower() if isinstance(value, bool) else str(value).strip()


def _length(region: dict) -> str:
    low, high = (int(v) if re.fullmatch(r"\d+", v) else 0 for v in (_text(region, "min_len"), _text(region, "max_len")))
    if low and high:
        return str(high) if low == high else f"{low}-{high}"
    seq = _text(region, "sequence")
    return str(len(seq)) if seq else str(high) if high else ""


def onlist(node: dict, folder: str) -> str:
    """Key of a known list, or the path of a local one; lists elsewhere must be fetched beforehand."""
    name, url = _text(node, "filename"), _text(node, "url")
    base = os.path.basename(name or url).lower()
    for part, key in KNOWN_LISTS.items():
        if part in base:
            return key
    if _text(node, "urltype") in ("http", "https", "ftp") or _text(node, "location") == "remote" or re.match("(https?|ftp)://", url):
        raise ValueError(f"list {name or url!r} is remote; fetch it and name the local file")
    for at in (os.path.join(folder, name if url in ("", ".", "./") else url), os.path.join(folder, url, name), os.path.join(folder, name)):
        if os.path.isfile(at):
            return os.path.realpath(at)
    raise FileNotFoundError(f"list {name or url!r} not found beside the description")


def _row(region: dict, folder: str) -> dict[str, str] | None:
    kind, form, seq = _text(region, "region_type").lower(), _text(region, "sequence_type").lower(), _text(region, "sequence")
    row = dict.fromkeys(("id", "seq", "expected_length", "type", "class", "whitelist", "flags"), "")
    row["id"] = _text(region, "region_id") or _text(region, "region_type") or "element"
    if kind in DROPPED:
        return None
    if kind in ("poly_a", "poly_t"):
        return row | {"id": kind, "type": "static", "class": kind}
    if form == "onlist" or kind == "barcode":
        listed = region.get("onlist")
        return row | {"type": "variable", "class": "barcode", "expected_length": _length(region), "whitelist": onlist(listed, folder) if isinstance(listed, dict) else ""}
    if kind == "umi":
        return row | {"type": "variable", "class": "umi", "expected_length": _length(region)}
    if kind in PAYLOAD or (form == "random" and not seq):
        return row | {"type": "variable", "class": "read"}
    if seq:
        group = "linker" if kind in ("linker", "custom_primer") else "tso" if kind == "bead_tso" else ""
        return row | {"type": "static", "seq": seq, "class": group}
    return None


def read_seqspec(path: str) -> tuple[str, list[dict[str, str]]]:
    """Mode and layout rows: leaf regions in order of the RNA modality if there is one, else of the first."""
    import yaml

    with open(path, encoding="utf-8") as f:
        root = yaml.safe_load(re.sub(r"!\w+", "", f.read()))
    spec = (root or {}).get("library_spec") or (root or {}).get("assay_spec")
    if not spec:
        raise ValueError("neither library_spec nor assay_spec in the description")
    tops = spec if isinstance(spec, list) else [spec]
    chosen = next((r for r in tops if "rna" in (_text(r, "region_id") + _text(r, "modality") + _text(r, "region_type")).lower()), tops[0])
    rows: list[dict[str, str]] = []
    todo = [chosen]
    while todo:
        region = todo.pop(0)
        inner = region.get("regions") or []
        if inner:
            todo = list(inner) + todo
        elif row := _row(region, os.path.dirname(os.path.abspath(path))):
            rows.append(row)
    if not rows:
        raise ValueError("no usable region in the description")
    return "" if any(r["class"] == "barcode" for r in rows) else "bulk", rows
