"""Operations of a large training-data pipeline, each a DataFrame -> DataFrame job.

``registry`` lists the queries of this subpackage; nothing outside it imports it.
"""
