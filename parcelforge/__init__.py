"""Parcelforge: address, gazetteer and parcel evidence processing on Spark DataFrames."""
