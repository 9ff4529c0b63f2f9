"""matchloom: record linkage and table preparation as Spark jobs.

``sources``    files to DataFrames          ``sinks``     DataFrames to tables
``functions``  Column expressions           ``operators`` DataFrame to DataFrame
``plans``      whole jobs with paths and a command line
"""
