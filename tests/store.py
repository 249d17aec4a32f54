"""A small record store on disk, written the way the scans expect it."""

from __future__ import annotations

import copy
import json
import uuid
from pathlib import Path

KEY = "0123456789abcdef" * 4
TOKEN = uuid.UUID(int=sum(i << 7 * i for i in range(18)), version=4).hex


def capture_id(n: int) -> str:
    """A distinct well-formed id."""
    letters = "klmnopqrstuvwxyz"
    tail = ""
    for _ in range(4):
        tail = letters[n % 16] + tail
        n //= 16
    return "z" * 28 + tail


def header(cid: str, **changes) -> dict:
    record = {
        "format_version": 4,
        "id": cid,
        "completed_at_unix_ms": 86_400_000,
        "build": {
            "package": "loom",
            "package_version": "3.2.1",
            "target": {"name": "loom", "kind": "lib"},
            "profile": "release",
            "cargo_program": "cargo",
            "invocation_directory": "/home/w/loom",
            "cargo_arguments": ["rustc"],
        },
        "compiler": {
            "rustc": "/opt/rust/bin/rustc",
            "release": "1.80.2",
            "commit_hash": "5e" * 20,
            "host": "x86_64-unknown-linux-gnu",
            "sysroot": "/opt/rust",
        },
        "analysis": {
            "request_key": KEY,
            "token": TOKEN,
            "artifact": {
                "package_id": "path+file:///home/w/loom#3.2.1",
                "manifest_path": "/home/w/loom/Cargo.toml",
                "target": {
                    "name": "loom",
                    "kind": ["lib"],
                    "crate_types": ["lib"],
                    "required-features": ["threads"],
                    "src_path": "/home/w/loom/src/lib.rs",
                    "edition": "2024",
                    "doc": True,
                    "doctest": True,
                    "test": True,
                },
                "profile": {
                    "opt_level": "3",
                    "debuginfo": 2,
                    "debug_assertions": False,
                    "overflow_checks": True,
                    "test": False,
                },
                "features": ["threads", "fast", "simd"],
                "filenames": ["/home/w/out/libloom.rlib"],
                "executable": None,
                "fresh": True,
            },
        },
    }
    return record | changes


def manifest(cid: str) -> dict:
    return {
        "format_version": 4,
        "capture_id": cid,
        "instances": [
            {
                "definition": {"crate_name": "loom", "definition_path": "loom::shed::weave"},
                "display_name": "weave::<[u8; 4]>",
                "raw_symbol": "loom_entry",
                "placements": [
                    {
                        "codegen_unit": "loom-unit.3",
                        "linkage": "External",
                        "visibility": "Default",
                        "local_copy": False,
                        "size_estimate": 204,
                    }
                ],
                "source": {
                    "available": {
                        "artifact": 5,
                        "range": {"start": 6, "length": 11},
                        "display_path": "shed/weave.rs",
                        "starting_line": 4,
                    }
                },
            }
        ],
        "artifacts": [
            {"id": 5, "kind": "source", "byte_len": 27},
            {"id": 9, "kind": "llvm", "byte_len": 33},
        ],
        "llvm_provenance": {
            "backend": "llvm",
            "llvm_version": "18.0.1",
            "target": "riscv64gc-unknown-linux-gnu",
            "optimization": "3",
            "lto": "off",
            "incremental": False,
            "linker_plugin_lto": False,
            "codegen_units": 6,
            "recipe_revision": 1,
        },
        "llvm": {
            "collected": [
                {
                    "artifact": 9,
                    "compiler_module": "loom-unit.3",
                    "stage": "no_lto_optimized",
                    "definitions": [
                        {
                            "raw_symbol": "weave_impl",
                            "range": {"start": 3, "length": 14},
                            "kind": "function",
                        },
                        {
                            "raw_symbol": "loom_entry",
                            "range": {"start": 17, "length": 12},
                            "kind": {"direct_alias": {"target": "weave_impl"}},
                        },
                    ],
                }
            ]
        },
    }


FILES = {5: b"fn a() {}\n\n\nfn weave() {}\n\n", 9: b"; m\n" + b"=" * 29}


def changed(record: dict, pointer: str, value) -> dict:
    """A copy with one field replaced; the pointer is `/a/0/b`."""
    result = copy.deepcopy(record)
    at = result
    *path, last = pointer.strip("/").split("/")
    for step in path:
        at = at[int(step)] if isinstance(at, list) else at[step]
    if isinstance(at, list):
        at[int(last)] = value
    else:
        at[last] = value
    return result


def write(root: Path, cid: str, head: dict | str | None, body: dict | str | None, files=FILES) -> None:
    folder = root / "captures" / cid
    folder.mkdir(parents=True, exist_ok=True)
    for name, record in (("capture.json", head), ("instances.json", body)):
        if record is not None:
            text = record if isinstance(record, str) else json.dumps(record) + "\n"
            (folder / name).write_text(text)
    for artifact, data in files.items():
        (folder / f"artifact-{artifact:016x}").write_bytes(data)


def write_pointer(root: Path, key: str, record: dict | str) -> None:
    folder = root / "candidates"
    folder.mkdir(parents=True, exist_ok=True)
    text = record if isinstance(record, str) else json.dumps(record)
    (folder / f"{key}.json").write_text(text)


def pointer(cid: str, key: str = KEY, token: str = TOKEN, version: int = 1) -> dict:
    return {"format_version": version, "request_key": key, "token": token, "capture_id": cid}
