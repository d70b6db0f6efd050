"""Tables that grow with the catalogue are never broadcast, whatever their files weigh."""

from citesieve.operators import identifiers, lookup
from citesieve.operators.parse import parse_citations
from citesieve.operators.staging import staged
from citesieve.plans import fixtures

SF = "/root/testdata/sf0.001"


def broadcasts(df):
    plan = df._jdf.queryExecution().executedPlan().toString()
    return plan.count("BroadcastExchange")


def test_records_are_not_gathered_by_the_driver(spark):
    cited, works = fixtures.citations(spark, SF), fixtures.works(spark, SF)
    assert broadcasts(cited) == 0
    parsed = staged(parse_citations(cited.limit(20)))
    found = [lookup.lookup_doi(parsed, works), lookup.lookup_pmid(parsed, works), lookup.lookup_pmcid(parsed, works), lookup.lookup_arxiv(parsed, works), lookup.lookup_ads(parsed, works)]
    found += [lookup.resolve_doi(found[0], fixtures.registry(spark, SF)), identifiers.lookup_all(parsed, identifiers.identifier_index(works))]
    found.append(lookup.review_lookup(found[1], works, fixtures.pub_types(spark, SF)))
    assert [broadcasts(df) for df in found] == [0] * len(found)
