"""Ordered steps of an evaluation, and what must be there before they start."""

from __future__ import annotations

import hashlib
import importlib.util
import os
from collections.abc import Callable, Mapping

from tessera.sources.files import fill_templates

CHUNK = 1 << 20


def run_steps(steps: list[dict], context: Mapping[str, str], jobs: Mapping[str, Callable[..., object]], dry_run: bool = False) -> list[tuple[str, str]]:
    """(name, state) of each step in order: disabled, planned in a dry run, else done.

    A step names its ``kind``, one of ``jobs``, and may have ``enabled`` and
    ``args``, whose {placeholders} the context fills. All kinds are looked up
    before anything runs; a job that raises ends the suite.
    """
    wanted = [(s.get("name", s.get("kind", "")), s) for s in steps]
    unknown = [str(s.get("kind")) for _, s in wanted if s.get("enabled", True) and s.get("kind") not in jobs]
    if unknown:
        raise ValueError(f"unknown kinds of steps: {', '.join(unknown)}")
    out = []
    for name, step in wanted:
        if not step.get("enabled", True):
            out.append((name, "disabled"))
        elif dry_run:
            out.append((name, "planned"))
        else:
            jobs[step["kind"]](**fill_templates(step.get("args", {}), context))
            out.append((name, "done"))
    return out


def preflight(packages: list[str] = (), files: Mapping[str, str | None] = {}) -> list[str]:
    """What is amiss on the driver: packages that are not installed, files that are missing or whose SHA-256 is not the one given."""
    wrong = [f"no package {p}" for p in packages if importlib.util.find_spec(p) is None]
    for path, digest in files.items():
        if not os.path.isfile(path):
            wrong.append(f"no file {path}")
        elif digest is not None:
            own = hashlib.sha256()
            with open(path, "rb") as f:
                while part := f.read(CHUNK):
                    own.update(part)
            if own.hexdigest() != digest.lower():
                wrong.append(f"{path} has digest {own.hexdigest()}")
    return wrong
