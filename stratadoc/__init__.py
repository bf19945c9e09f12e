"""PySpark analytics over corpora of structured documents and the runs that process them."""
