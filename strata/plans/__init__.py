"""Running SELECTs, cells and scripts over the layers."""
