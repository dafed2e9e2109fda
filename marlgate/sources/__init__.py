"""Reading documents, page images, boxes, texts and results; and writing results."""
