"""A PySpark-native engine for address, place and parcel data."""
