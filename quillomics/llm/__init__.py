"""Operations of a training-data pipeline over tables of documents, pages and conversations.

Nothing else in the library imports this package. ``catalog`` holds its runnable queries.
"""
