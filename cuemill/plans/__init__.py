"""Plans of the transcript, feed and release library."""


def registered():
    """The catalog, with all queries of the library entered."""
    from . import catalog, column_queries, feed_queries, flagship, more_queries, release_queries, text_queries, time_queries, transcript_queries  # noqa: F401

    return catalog
