"""All registered queries of the postings engine; importing the modules registers them."""

from boardlake.functions import boards, dates, enrich, fields, geo, hiring, industry, pay, places, sources, text
from boardlake.operators import aggregates, filters, history, joins, lifecycle, listing, matching, outcomes, relevance, scores, similar, upkeep
from boardlake.registry import ORACLE_SQL, QUERIES
from boardlake.sources import inspection, pages, payloads
from boardlake.streaming import stateful, streams

MODULES = (
    aggregates, boards, dates, enrich, fields, filters, geo, hiring, history, industry, inspection, joins, lifecycle, listing, matching, outcomes, pages, pay, payloads, places, relevance, scores, similar, sources, stateful, streams, text, upkeep,
)
FLAGSHIP = "q_listing"

__all__ = ["FLAGSHIP", "ORACLE_SQL", "QUERIES"]
