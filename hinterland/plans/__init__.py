"""Whole pipelines: measures by area, institution panel, analysis panel, model grid."""
