"""Compositions of operators: the batch plan and the query catalog."""


def catalogs() -> list:
    from claimloom.plans import catalog_claims, catalog_documents, catalog_facts, catalog_review, catalog_serving, catalog_streams, catalog_vectors
    return [catalog_claims.catalog, catalog_review.catalog, catalog_serving.catalog, catalog_vectors.catalog,
            catalog_documents.catalog, catalog_facts.catalog, catalog_streams.catalog]
