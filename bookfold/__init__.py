"""bookfold: order-book analytics and training-data operators on Spark DataFrames."""
