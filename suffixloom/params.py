"""Immutable parameters of the models."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Params:
    """Values that define the models' semantics.  Fixed values."""

    alpha: float = 0.01
    gamma: float = 0.037
    discount: float = 1.0
    smoothing: float = 0.01
    laplace: float = 1e-7
    min_stem: int = 2
    sim_unsegmented: float = 1.0
    sim_unfound: float = 0.1
    low_sim: float = 0.001
    sim_cut: float = 0.25
    boundary_children: int = 3
    poisson_lambda: float = 4.0
    block_alpha: float = 0.1
    block_laplace: float = 0.1
    upper_cosine: float = 0.99
    affix_alphabet: float = 29.0
    seed: int = 42


DEFAULT = Params()
