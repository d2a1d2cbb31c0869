"""Operations of a training-data pipeline over corpora of documents, pages and
vectors (one module per operator, registered in ``queries``)."""
