from siterank.plans.features import FeatureLayers, feature_matrix
from siterank.plans.prioritize import prioritize, prioritize_subset
from siterank.plans.roster import RosterInputs, build_roster
from siterank.plans.sites import LabelLayers, label_sites

__all__ = [
    "FeatureLayers",
    "LabelLayers",
    "RosterInputs",
    "build_roster",
    "feature_matrix",
    "label_sites",
    "prioritize",
    "prioritize_subset",
]
