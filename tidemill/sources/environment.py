"""What a run records about its machine, and what keeps a run from starting."""

from __future__ import annotations

import platform
import re
import subprocess
from collections.abc import Callable
from importlib import metadata
from typing import Any

#: Shell lines whose output is a fact; a line that fails gives none.
LINES = {"rocm": "rocminfo", "commit": "git -C {folder} rev-parse HEAD", "changes": "git -C {folder} status --porcelain"}
PACKAGES = ("pyspark", "pyarrow", "torch", "transformers", "vllm")
#: Oldest serving library that a GPU run takes.
LEAST_VLLM = (0, 29)

Facts = dict[str, Any]


def heard(line: str, seconds: int = 30) -> str | None:
    status, text = subprocess.getstatusoutput(f"timeout {seconds} {line} 2>/dev/null")
    return None if status else text.strip()


def facts(folder: str = ".") -> Facts:
    """Flat facts: system, versions (pkg.*), what the shell lines say, and the GPUs that torch sees (None without torch)."""
    found: Facts = {"python": platform.python_version(), "system": platform.platform(), "host": platform.node(), "gpus": None}
    found |= {f"pkg.{p}": None for p in PACKAGES} | {f"pkg.{d.name}": d.version for d in metadata.distributions() if d.name in PACKAGES}
    found |= {name: heard(line.format(folder=folder)) for name, line in LINES.items()}
    if found["pkg.torch"]:
        import torch

        found["gpus"] = torch.cuda.device_count() if torch.cuda.is_available() else 0
    return found


def _release(version: str | None) -> tuple[int, ...]:
    return tuple(int(n) for n in re.findall("[0-9]+", version or "")[:2])


#: For which back ends a fact must hold, what must hold, and what is said where it does not.
NEEDS: tuple[tuple[frozenset[str], Callable[[Facts], bool], str], ...] = (
    (frozenset(("hf", "vllm")), lambda f: f["rocm"] is not None, "rocminfo gives nothing"),
    (frozenset(("hf", "vllm")), lambda f: f["gpus"] is not None, "torch is not installed"),
    (frozenset(("hf", "vllm")), lambda f: f["gpus"] != 0, "torch sees no GPU"),
    (frozenset(("vllm",)), lambda f: f["pkg.vllm"] is not None, "vllm is not installed"),
    (frozenset(("vllm",)), lambda f: f["pkg.vllm"] is None or _release(f["pkg.vllm"]) >= LEAST_VLLM, "vllm {pkg.vllm} is too old"),
    (frozenset(("vllm",)), lambda f: "gfx950" in (f["rocm"] or "") or "gfx908" not in (f["rocm"] or ""), "gfx908 is served by hf only"),
)


def problems(found: Facts, backend: str) -> list[str]:
    """What stops a run of the back end on this machine; none for one that needs no GPU."""
    return [re.sub(r"\{(.*?)\}", lambda m: str(found[m[1]]), said) for ends, holds, said in NEEDS if backend in ends and not holds(found)]
