"""Run configuration: nested frozen dataclasses that reject what they do not know."""

from __future__ import annotations

import dataclasses
import json
from dataclasses import dataclass, field
from typing import Any

#: A section's seed of this value takes the run's seed.
UNSET_SEED = 7


@dataclass(frozen=True)
class Sketch:
    k: int = 31
    bin_size: int = 10_000
    scaled: int = 200
    min_bin_acgt_frac: float = 0.5
    min_bin_sketch: int = 5
    include_unplaced: bool = False
    drop_partial_terminal_bin: bool = True


@dataclass(frozen=True)
class Manifest:
    source: str = "file"
    path: str = ""
    chroms: tuple[str, ...] = ("chr21",)
    max_samples: int = 0
    max_assemblies: int = 0
    require_annotations: tuple[str, ...] = ("censat_bed",)
    populations: tuple[str, ...] = ()
    samples: tuple[str, ...] = ()
    exclude_samples: tuple[str, ...] = ()
    annotation_tables: tuple[str, ...] = ("censat_bed", "repeatmasker_bed", "segdup_bed", "chrom_alias")
    require_complete: bool = False
    seed: int = UNSET_SEED


@dataclass(frozen=True)
class Annotate:
    reference_tracks: tuple[str, ...] = ("censat", "repeatmasker", "segdup", "telomere", "gene")
    assembly_tracks: tuple[str, ...] = ("censat", "repeatmasker", "segdup")
    catalog: tuple[str, ...] = ()
    min_frac_for_dominant: float = 0.25
    annotate_assemblies: bool = False


@dataclass(frozen=True)
class Report:
    max_points: int = 1_000_000
    title: str = ""
    findings: str = ""
    seed: int = UNSET_SEED


@dataclass(frozen=True)
class Select:
    min_sample_prevalence: float = 0.10
    max_sample_prevalence: float = 1.0
    min_bins: int = 2
    max_features: int = 200_000
    seed: int = UNSET_SEED


@dataclass(frozen=True)
class Matrix:
    weighting: str = "idf"
    row_norm: str = "l2"


@dataclass(frozen=True)
class Decompose:
    n_components: int = 64
    n_oversamples: int = 20
    n_iter: int = 7
    drop_first: int = 0
    seed: int = UNSET_SEED


@dataclass(frozen=True)
class Embed:
    n_neighbors: int = 30
    min_dist: float = 0.05
    metric: str = "cosine"
    n_components: int = 2
    max_fit_rows: int = 400_000
    seed: int = UNSET_SEED


@dataclass(frozen=True)
class Cluster:
    method: str = "hdbscan"
    space: str = "embedding"
    min_cluster_size: int = 50
    min_samples: int = 10
    cluster_selection_epsilon: float = 0.0
    cluster_selection_method: str = "eom"
    eps: float = 0.5
    max_fit_rows: int = 0
    seed: int = UNSET_SEED


@dataclass(frozen=True)
class Enrich:
    min_cluster_size: int = 10
    min_frac: float = 0.25
    top_features: int = 3


@dataclass(frozen=True)
class Config:
    run_name: str = "run"
    outdir: str = "out"
    seed: int = UNSET_SEED
    manifest: Manifest = field(default_factory=Manifest)
    sketch: Sketch = field(default_factory=Sketch)
    select: Select = field(default_factory=Select)
    matrix: Matrix = field(default_factory=Matrix)
    decompose: Decompose = field(default_factory=Decompose)
    embed: Embed = field(default_factory=Embed)
    cluster: Cluster = field(default_factory=Cluster)
    annotate: Annotate = field(default_factory=Annotate)
    enrich: Enrich = field(default_factory=Enrich)
    report: Report = field(default_factory=Report)


def from_dict(data: dict[str, Any]) -> Config:
    """A validated configuration; unknown keys and broken rules are reported together."""
    problems: list[str] = []

    def build(kind, values: dict, path: str):
        known = {f.name: f for f in dataclasses.fields(kind)}
        problems.extend(f"unknown key {path}{k}" for k in values if k not in known)
        made = {}
        for name, f in known.items():
            if name in values:
                default = f.default_factory() if f.default_factory is not dataclasses.MISSING else f.default
                made[name] = build(type(default), values[name] or {}, f"{path}{name}.") if dataclasses.is_dataclass(default) else tuple(values[name]) if isinstance(default, tuple) else values[name]
        return kind(**made)

    config = spread_seed(build(Config, data, ""))
    problems += validate(config)
    if problems:
        raise ValueError("; ".join(problems))
    return config


def spread_seed(config: Config) -> Config:
    sections = {f.name: getattr(config, f.name) for f in dataclasses.fields(config)}
    changed = {n: dataclasses.replace(s, seed=config.seed) for n, s in sections.items() if dataclasses.is_dataclass(s) and getattr(s, "seed", None) == UNSET_SEED}
    return dataclasses.replace(config, **changed)


def validate(c: Config) -> list[str]:
    rules = [
        (c.sketch.k % 2 == 1 and 3 <= c.sketch.k <= 31, "sketch.k must be odd, from 3 to 31"),
        (c.sketch.bin_size >= c.sketch.k, "sketch.bin_size must be at least k"),
        (c.sketch.scaled >= 1, "sketch.scaled must be 1 or more"),
        (0 <= c.sketch.min_bin_acgt_frac <= 1, "sketch.min_bin_acgt_frac must be from 0 to 1"),
        (c.sketch.min_bin_sketch >= 0, "sketch.min_bin_sketch must not be negative"),
        (0 <= c.select.min_sample_prevalence <= c.select.max_sample_prevalence <= 1, "select prevalences must rise from 0 to 1"),
        (c.select.min_bins >= 1, "select.min_bins must be 1 or more"),
        (c.select.max_features >= 0, "select.max_features must not be negative"),
        (c.matrix.weighting in ("idf", "log", "none"), "matrix.weighting must be idf, log or none"),
        (c.matrix.row_norm in ("l1", "l2", "none"), "matrix.row_norm must be l1, l2 or none"),
        (c.decompose.n_components >= 1, "decompose.n_components must be 1 or more"),
        (c.embed.n_components in (2, 3), "embed.n_components must be 2 or 3"),
        (c.cluster.method in ("hdbscan", "dbscan"), "cluster.method must be hdbscan or dbscan"),
        (c.cluster.space in ("embedding", "pcs"), "cluster.space must be embedding or pcs"),
        (c.cluster.cluster_selection_method in ("eom", "leaf"), "cluster.cluster_selection_method must be eom or leaf"),
        (c.enrich.top_features >= 1, "enrich.top_features must be 1 or more"),
        (c.manifest.source in ("file", "folder", "release"), "manifest.source must be file, folder or release"),
        (0 <= c.annotate.min_frac_for_dominant <= 1, "annotate.min_frac_for_dominant must be from 0 to 1"),
        (all("=" in x for x in c.annotate.catalog), "annotate.catalog holds kind=path"),
        (c.report.max_points >= 0, "report.max_points must not be negative"),
    ]
    return [text for ok, text in rules if not ok]


def overridden(data: dict[str, Any], changes: list[str]) -> dict[str, Any]:
    """``data`` with dotted ``section.key=value`` changes; values are read as JSON where they can be."""
    out = json.loads(json.dumps(data))
    for change in changes:
        path, eq, text = change.partition("=")
        if not eq:
            raise ValueError(f"not key=value: {change}")
        try:
            value = json.loads(text)
        except json.JSONDecodeError:
            value = text
        at = out
        *parents, last = path.split(".")
        for p in parents:
            at = at.setdefault(p, {})
        at[last] = value
    return out


def load(path: str, changes: list[str] = ()) -> Config:
    with open(path) as f:
        return from_dict(overridden(json.load(f), list(changes)))
