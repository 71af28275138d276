"""The registered queries by subject; each module has QUERIES and ORACLES."""

from palimpsest.plans import answers, gates, ingested, maintenance, markdown, matching, merged, projected, proved, receipts, registry, responded, selection, stored

MODULES = (registry, maintenance, answers, matching, selection, gates, stored, receipts, markdown, merged, projected, proved, ingested, responded)
