"""Programs written in Python: ``weftline.sdk.nodes`` builds calls, the other modules combine them."""
