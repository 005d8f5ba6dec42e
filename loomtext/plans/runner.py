"""Experiment runs on the driver: signatures, resuming, archives and state files of a job list.

Jobs are dictionaries (rows of :func:`loomtext.operators.matrix.job_matrix`); a backend is a callable that
trains and evaluates one job and returns ``{eval_set: {precision, recall, f1, loss}}``.
"""

from __future__ import annotations

import hashlib
import json
import platform
import re
import shutil
from collections.abc import Callable
from datetime import datetime, timezone
from importlib import metadata
from pathlib import Path

METRICS = ("precision", "recall", "f1", "loss")
STATUSES = ("running", "completed", "failed")


def digest(value: object) -> str:
    """SHA-256 of compact JSON with sorted keys."""
    return hashlib.sha256(json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False, default=str).encode()).hexdigest()


def profile_ids(models: list[dict]) -> list[str]:
    """Distinct slugs of model names, numbered when they repeat."""
    out: list[str] = []
    for m in models:
        slug = re.sub(r"[^a-z0-9]+", "-", str(m.get("name") or m.get("id") or "").lower()).strip("-")[:80] or "model"
        n = sum(x == slug or re.fullmatch(rf"{re.escape(slug)}-\d+", x) is not None for x in out)
        out.append(slug if not n else f"{slug}-{n + 1}")
    return out


def run_dir(root: Path, job: dict) -> Path:
    return root / "runs" / str(job["model"]) / str(job["set"]) / f"seed_{job['seed']}" / str(job["train_variant"])


def _read(path: Path) -> dict | None:
    try:
        return json.loads(path.read_text())
    except (OSError, ValueError):
        return None


def _write(path: Path, value: dict) -> str:
    text = json.dumps(value, indent=2, sort_keys=True) + "\n"
    path.write_text(text)
    return hashlib.sha256(text.encode()).hexdigest()


def checked_metrics(metrics: dict, eval_sets: list[str]) -> dict:
    """Metrics with every eval set and number; else an error."""
    for s in eval_sets:
        if s not in metrics:
            raise ValueError(f"backend gave no metrics for {s}")
        if bad := [m for m in METRICS if not isinstance(metrics[s].get(m), (int, float))]:
            raise ValueError(f"backend gave no {bad[0]} for {s}")
    return metrics


def can_resume(folder: Path, signature: str) -> bool:
    """Whether a completed run of the same signature lies there with the metrics it claims."""
    state = _read(folder / "run_state.json") or {}
    if state.get("status") != "completed" or state.get("signature") != signature or not (folder / "metrics.json").exists():
        return False
    return hashlib.sha256((folder / "metrics.json").read_bytes()).hexdigest() == state.get("metrics_sha256")


def archive(folder: Path, reason: str) -> Path | None:
    """Move the files of an earlier attempt into ``attempts/<n>-<reason>``."""
    files = [p for p in folder.iterdir() if p.name != "attempts"] if folder.exists() else []
    if not files:
        return None
    n = len(list((folder / "attempts").glob("*"))) + 1
    target = folder / "attempts" / f"{n:03d}-{re.sub(r'[^a-z0-9]+', '-', reason.lower()).strip('-')}"
    target.mkdir(parents=True)
    for p in files:
        shutil.move(str(p), target / p.name)
    return target


def _state(folder: Path, status: str, signature: str, **more) -> None:
    for s in STATUSES:
        (folder / f"STATUS_{s}").unlink(missing_ok=True)
    (folder / f"STATUS_{status}").touch()
    _write(folder / "run_state.json", {"status": status, "signature": signature, "updated_at": datetime.now(timezone.utc).isoformat(), **more})


def run_matrix(jobs: list[dict], backend: Callable[[dict], dict], root: str | Path, *, resume: bool = True, extra: dict | None = None) -> list[dict]:
    """Run jobs in order; (job, status, metrics) of each. A failing job records its state and stops the matrix."""
    out = []
    for job in jobs:
        folder = run_dir(Path(root), job)
        signature = digest({"job": job, "extra": extra or {}})
        if resume and can_resume(folder, signature):
            out.append({"job": job, "status": "skipped", "metrics": _read(folder / "metrics.json")["metrics"]})
            continue
        archive(folder, "rerun" if (folder / "run_state.json").exists() else "partial")
        folder.mkdir(parents=True, exist_ok=True)
        _write(folder / "run_spec.json", {"signature": signature, "payload": {"job": job, "extra": extra or {}}})
        _state(folder, "running", signature)
        try:
            metrics = checked_metrics(backend(job), list(job.get("eval_sets") or []))
        except Exception as e:
            _state(folder, "failed", signature, error=str(e))
            raise
        identity = {k: job.get(k) for k in ("task", "set", "seed", "train_variant", "eval_split")} | {"model_id": job["model"]}
        sha = _write(folder / "metrics.json", identity | {"metrics": metrics})
        _state(folder, "completed", signature, metrics_sha256=sha)
        out.append({"job": job, "status": "completed", "metrics": metrics})
    return out


def with_epochs(config: dict, epochs: dict[str, int]) -> dict:
    """A copy of a run config whose models have calibrated epochs."""
    out = json.loads(json.dumps(config))
    for m in out.get("training", {}).get("models", []):
        if m.get("name") in epochs:
            m.setdefault("hparams", {})["epochs"] = int(epochs[m["name"]])
    return out


def provenance(config: dict, packages: tuple[str, ...] = ("pyspark", "pandas", "pyarrow", "numpy")) -> dict:
    """What a run was made with: interpreter, package versions, digest of the configuration."""
    found = {}
    for name in packages:
        try:
            found[name] = metadata.version(name)
        except metadata.PackageNotFoundError:
            found[name] = None
    return {"python": platform.python_version(), "platform": platform.system(), "packages": found, "config_sha256": digest(config)}


def source_root(preferred: str, profiles: dict[str, str], job: dict, complete: Callable[[str, dict], bool]) -> str:
    """The root that has a job's files: the preferred one, that of the job's profile, else the only other profile's.

    ``profiles``: root of each profile id; ``complete`` tells whether a root has
    all files of the job (see :func:`loomtext.operators.claims.missing_artifacts`).
    None is an error, and so are several.
    """
    own = profiles.get(str(job.get("profile_id") or ""))
    for root in (preferred, own):
        if root is not None and complete(root, job):
            return root
    others = [r for _, r in sorted(profiles.items()) if r not in (preferred, own) and complete(r, job)]
    if len(others) > 1:
        raise ValueError("several profiles have the files of the job: " + ", ".join(others))
    if not others:
        raise FileNotFoundError(f"no root has the files of task {job.get('task')}, set {job.get('set')}, variant {job.get('train_variant')}")
    return others[0]


def variant_stats(manifest: dict, variant: str, train_set: str | None = None) -> dict:
    """Statistics of a train variant in a manifest, of one lineage or of an experiment over several; an ambiguous one is an error."""
    train = (manifest.get("dataset_stats") or {}).get("train")
    if not isinstance(train, dict):
        raise ValueError("the manifest has no train statistics")

    def of(entry) -> dict | None:
        entry = entry if isinstance(entry, dict) else {}
        found = (entry.get("variants") or {}).get(variant, entry.get(variant))
        return found if isinstance(found, dict) else None

    own = of(train)
    if own is None:
        asked = [train_set] if train_set else sorted(train)
        several = [x for x in (of(train.get(k)) for k in asked) if x is not None]
        if len(several) != 1:
            raise ValueError(f"variant {variant} stands in {len(several)} train sets")
        own = several[0]
    return own
