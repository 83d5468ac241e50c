"""Names of the model's variables, as traces and reports use them."""

from __future__ import annotations

from enum import Enum


class Name(str, Enum):
    """The variables of a trace."""

    GROWTH = "growth"
    SELF_INTERACTION = "self_interaction"
    INTERACTION = "interaction"
    CLUSTER = "cluster"
    N_CLUSTERS = "n_clusters"
    CONCENTRATION = "concentration"
    PROCESS_VARIANCE = "process_variance"
    EDGE_PROBABILITY = "edge_probability"
    PERTURBATION = "perturbation"
    QPCR_SCALE = "qpcr_scale"


PERTURBATION_NAMES = frozenset({Name.PERTURBATION})
SYMBOLS = {
    Name.GROWTH: "a_{1}", Name.SELF_INTERACTION: "a_{2}", Name.INTERACTION: "b", Name.CLUSTER: "c", Name.N_CLUSTERS: "K",
    Name.CONCENTRATION: r"\alpha", Name.PROCESS_VARIANCE: r"\sigma^2", Name.EDGE_PROBABILITY: r"\pi_z",
    Name.PERTURBATION: r"\gamma", Name.QPCR_SCALE: r"\sigma_Q",
}


def is_perturbation_parameter(name: str) -> bool:
    return any(name == n.value or name.startswith(n.value + "_") for n in PERTURBATION_NAMES)


def latex(name: str) -> str:
    """The symbol in dollar signs; an unknown name as text."""
    try:
        return f"${SYMBOLS[Name(name)]}$"
    except ValueError:
        return name.replace("_", r"\_")
